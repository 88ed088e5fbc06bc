"""The query language: lexer, parser, syntax tree."""
