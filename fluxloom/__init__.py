"""fluxloom: trace-gas flux analytics and observation cleaning on Spark DataFrames."""
