"""What an operator of a cluster gives and reads: the list of copies, and log lines."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from findery.errors import InvalidTopology

COPIES = "shard_id int, copy_no int, copy_role string, node_state string, endpoint string"
_PLAIN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


def _addresses(text: str) -> list[str]:
    return [a for a in map(str.strip, text.split(",")) if a]


def parsed_topology(spark: SparkSession, primaries: str, replicas: str = "", state: str = "ready") -> DataFrame:
    """The copies (COPIES) of addresses given as text: primaries of shards 0, 1, 2, ... between commas; their replicas in
    the same order between semicolons, those of one shard between commas. Blanks and empty entries are left out.

    Where replicas are given there must be as many groups as primaries, and no address may come twice.
    """
    first = _addresses(primaries)
    groups = [_addresses(g) for g in replicas.split(";")] if replicas.strip() else [[] for _ in first]
    if len(groups) != len(first):
        raise InvalidTopology(f"{len(first)} primaries, but replicas of {len(groups)} shards")
    rows = [(shard, no, "replica" if no else "primary", state, a) for shard, (p, group) in enumerate(zip(first, groups)) for no, a in enumerate([p, *group])]
    if len({r[4] for r in rows}) < len(rows):
        raise InvalidTopology("an address is given twice")
    return spark.createDataFrame(rows, COPIES)


class JsonLines(logging.Formatter):
    """A log record as one line of JSON: when (UTC), level, logger, message, whatever else the caller attached, and the
    traceback if there is one. What JSON cannot hold is written as text."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False, default=str)
