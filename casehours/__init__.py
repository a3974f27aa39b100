"""casehours: hourly power-grid study results, analysed as Spark DataFrames."""
