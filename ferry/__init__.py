"""ferry: DataFrame operators for landing files and accounting for their transfer."""
