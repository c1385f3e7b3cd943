"""Typed errors."""


class QuarryError(Exception):
    kind = "query_error"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class ValidationError(QuarryError):
    kind = "validation_error"


class ConfigurationError(QuarryError):
    kind = "configuration_error"


class FieldResolutionError(QuarryError):
    kind = "field_resolution_error"


class NoResults(QuarryError):
    kind = "no_results"


class MultipleResults(QuarryError):
    kind = "multiple_results"


class TransformationError(QuarryError):
    kind = "transformation_error"


class Timeout(QuarryError):
    kind = "timeout_error"


class ConnectionFailed(QuarryError):
    kind = "connection_error"


class QueryError(QuarryError):
    kind = "query_error"
