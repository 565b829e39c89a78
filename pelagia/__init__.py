"""Marine-advisory analytics as Spark DataFrame operators.

Every operator takes DataFrames plus an explicit ``as_of`` time where the clock
matters and returns a DataFrame; nothing is executed until the caller acts.
"""
