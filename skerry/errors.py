"""One exception for all engine errors; code is stable and machine-readable."""


class EngineError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code
