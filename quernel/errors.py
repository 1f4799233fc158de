"""What can go wrong, by kind."""


class EngineError(Exception):
    """Any error of the engine."""


class ParseError(EngineError):
    def __init__(self, position: int, message: str):
        super().__init__(f"{message} (at {position})")
        self.position = position


class BindError(EngineError):
    """An unknown or ambiguous name, or types that don't go together."""


class CatalogError(EngineError):
    """A table or index that is there already, or isn't."""


class ConstraintError(EngineError):
    """A value that a column must not hold."""


class TxnError(EngineError):
    """A transaction statement where it has no place."""


class WriteConflict(EngineError):
    """Another transaction changed the same first; try again."""


class SerializationFailure(EngineError):
    """The transaction's reads and writes fit no serial order; try again."""
