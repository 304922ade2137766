"""Reading loan files, crosswalks and results, and writing them."""

from loanfate.sources.readers import read_crosswalk, read_loan_archives, read_loans, read_result, read_zip_base
from loanfate.sources.writers import (
    dropped, read_facts, release, scratch_path, shuffles_freed, staged, write_facts, write_loan_archives, write_result,
)

__all__ = [
    "dropped", "read_crosswalk", "read_facts", "read_loan_archives", "read_loans", "read_result", "read_zip_base",
    "release", "scratch_path", "shuffles_freed", "staged", "write_facts", "write_loan_archives", "write_result",
]
