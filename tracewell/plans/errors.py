class RuleError(ValueError):
    """A rule that cannot be loaded."""
