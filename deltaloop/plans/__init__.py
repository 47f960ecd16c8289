"""Program model, parser, stratifier, rule compiler and fixpoint driver."""
