"""Errors of the engine."""

from __future__ import annotations


class VectorError(ValueError):
    """Any rejected vector, query or setting."""


class EmptyDataset(VectorError):
    def __init__(self):
        super().__init__("no rows: a table of vectors needs one or more")


class EmptyVector(VectorError):
    def __init__(self):
        super().__init__("vectors need one component or more")


class DimensionMismatch(VectorError):
    def __init__(self, expected: int, actual: int):
        self.expected, self.actual = expected, actual
        super().__init__(f"a vector of {actual} components where all have {expected}")


class NonFiniteValue(VectorError):
    def __init__(self, vector: int, dimension: int):
        self.vector, self.dimension = vector, dimension
        super().__init__(f"component {dimension} of vector {vector} is not a finite number")


class ZeroNorm(VectorError):
    def __init__(self, vector: int):
        self.vector = vector
        super().__init__(f"vector {vector} is all zeros and has no direction for cosine distance")


class InvalidConfig(VectorError):
    def __init__(self, message: str):
        super().__init__(f"index setting rejected: {message}")


class DuplicateId(VectorError):
    def __init__(self, vector_id: int):
        super().__init__(f"duplicate vector id {vector_id}")
