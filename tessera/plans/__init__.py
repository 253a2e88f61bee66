"""SQL text to bound plans: lexer, parser, binder and logical plans."""
