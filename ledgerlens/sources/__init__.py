"""Sources and sinks for ``customer_transactions``."""

from ledgerlens.sources.fixture import (
    BROKEN_KEYS_SQL,
    FIXTURE_SQL,
    broken_keys_from_tpch,
    states_from_tpch,
    transactions_from_tpch,
)
from ledgerlens.sources.tables import (
    jdbc_options,
    read_transactions_csv,
    read_transactions_jdbc,
    read_transactions_parquet,
    to_json_rows,
    write_json,
    write_transactions,
    write_transactions_csv,
)

__all__ = [
    "BROKEN_KEYS_SQL",
    "FIXTURE_SQL",
    "broken_keys_from_tpch",
    "states_from_tpch",
    "transactions_from_tpch",
    "jdbc_options",
    "read_transactions_csv",
    "read_transactions_jdbc",
    "read_transactions_parquet",
    "to_json_rows",
    "write_json",
    "write_transactions",
    "write_transactions_csv",
]
