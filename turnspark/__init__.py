"""turnspark: DataFrame operators for labelled text turns and multichannel signal trials."""
