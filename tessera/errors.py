"""Errors of the SQL front end."""


class EngineError(Exception):
    pass


class TableNotFound(EngineError):
    pass


class TableAlreadyExists(EngineError):
    pass


class ColumnNotFound(EngineError):
    pass


class ColumnCountMismatch(EngineError):
    pass


class TypeMismatch(EngineError):
    pass


class UniqueViolation(EngineError):
    pass


class ForeignKeyViolation(EngineError):
    pass


class NotNullViolation(EngineError):
    pass


class ParseError(EngineError):
    pass


class DatabaseNotFound(EngineError):
    pass


class DatabaseAlreadyExists(EngineError):
    pass


class UserNotFound(EngineError):
    pass


class UserAlreadyExists(EngineError):
    pass


class RoleNotFound(EngineError):
    pass


class RoleAlreadyExists(EngineError):
    pass


class AuthenticationFailed(EngineError):
    pass


class PermissionDenied(EngineError):
    pass


class ConcurrentWrite(EngineError):
    """Another engine changed the catalogue since this one read it; the statement or transaction can be run again."""
