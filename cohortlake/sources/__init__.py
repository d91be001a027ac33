from cohortlake.sources.tables import SCHEMAS, read_table, write_bucketed, write_table
from cohortlake.sources.typed import rejected_cells, typed

__all__ = ["SCHEMAS", "read_table", "rejected_cells", "typed", "write_bucketed", "write_table"]
