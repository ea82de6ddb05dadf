"""Errors of the engine."""


class CubeError(ValueError):
    """Anything a caller may have got wrong."""


class SpecError(CubeError):
    """A spec with problems; ``problems`` lists all of them."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


class CodecError(CubeError):
    """Bytes that are not a valid state or sketch."""


class ConflictError(CubeError):
    """A publication or claim that the control store refuses; ``kind`` says which rule."""

    def __init__(self, kind: str, text: str):
        super().__init__(f"{kind}: {text}")
        self.kind = kind


class IncompleteError(CubeError):
    """A range that cannot be answered exactly; ``missing`` lists the windows."""

    def __init__(self, text: str, missing: list[str]):
        super().__init__(text)
        self.missing = missing
