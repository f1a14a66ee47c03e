from tests.oracle import rows_of, same_rows

__all__ = ["rows_of", "same_rows"]
