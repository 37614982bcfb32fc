"""Errors that queries raise, by class."""


class QueryError(Exception):
    """Anything wrong with a query or its data."""


class ParseError(QueryError):
    """The text isn't a query."""


class ValidationError(QueryError):
    """Names, arities, limits or placement of clauses are wrong."""


class UnknownCollection(QueryError):
    """No collection has that name."""


class UnknownDocument(QueryError):
    """No document has that key."""


class BindError(QueryError):
    """A bind value is missing, unexpected or of the wrong kind."""


class TypeMismatch(QueryError):
    """A value of another type is needed: a number, bool, vector or array."""


class Conflict(QueryError):
    """A key is taken."""


class UniqueViolation(Conflict):
    """A unique index has that value already."""


class MutationNotAllowed(QueryError):
    """A read-only call got a mutation."""


class BadKey(QueryError):
    """A mutation's key is no key of that collection."""


class BudgetExceeded(QueryError):
    """A traversal has too many paths."""
