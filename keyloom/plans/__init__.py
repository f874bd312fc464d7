"""From statements to DataFrames: lexer, parser, validator, expressions, access paths, planner."""
