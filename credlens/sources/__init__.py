"""Reading tables and workbooks."""

from .readers import read, read_bytes, read_csv
from .workbook import Workbook, read_xlsx

__all__ = ["Workbook", "read", "read_bytes", "read_csv", "read_xlsx"]
