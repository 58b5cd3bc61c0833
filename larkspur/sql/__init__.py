"""Front-end of the dialect: lexer, parser and lowering to Spark SQL."""
