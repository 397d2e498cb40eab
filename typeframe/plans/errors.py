"""What is raised while a plan is built, before any job runs."""


class PlanError(ValueError):
    """A plan that cannot be valid."""


class SchemaError(PlanError):
    """An unknown or ambiguous attribute, or a type that does not fit."""


class ModelError(PlanError):
    """A schema that does not conform to a data model."""
