"""A mailbox as a source for Spark: in one go with filters pushed down, or as a stream with offsets of its own.

A mailbox is a folder of Parquet with a row a mail (MAIL): `history_id` rises with every mail that comes, `status` is what
fetching it answers. A page is a row group. Pages that filters or offsets rule out by their statistics aren't read; of the
others the headers come first, and bodies only where a sender counts. `_expired` in the folder names the oldest history that
can still be replayed.

An offset is the newest history and its time, taken before anything is listed, so that what comes meanwhile is the next
run's. From an offset that has expired a stream goes back OVERLAP_MS before its time and lists by time; `write_once` drops what it
has already.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith
from pyspark.sql.types import StructType

from ledgerloom.rules import messages as R
from ledgerloom.session import exists
from ledgerloom.streaming.state import BUCKETS, append_once

MAIL = "user_id long, history_id long, message_id long, arrived_at long, status int, sender string, subject string, body string"
_HEADERS, _BODIES = ["user_id", "history_id", "message_id", "arrived_at", "status", "sender"], ["subject", "body"]
#: How far a stream goes back from an offset that can't be replayed.
OVERLAP_MS = 24 * 3_600_000
#: Octets of a page in memory when it is written, and mails of one that are held at once when it is read.
PAGE_BYTES, HELD = 16 << 20, 5_000
#: Senders of all known providers.
KNOWN = "|".join(f"(?:{p[3]})" for p in R.PROVIDERS)


def store(mails: DataFrame, path: str, mode: str = "append") -> None:
    """Put mails (MAIL) into a mailbox, in order of their history."""
    mails.select(*[c.split()[0] for c in MAIL.split(", ")]).repartitionByRange("history_id").sortWithinPartitions("history_id").write.mode(mode).option("parquet.block.size", PAGE_BYTES).parquet(path)


def _system(path: str):
    """The file system that path names, and the place there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _files(path: str):
    from pyarrow import fs

    system, where = _system(path)
    infos = system.get_file_info(fs.FileSelector(where))
    return system, sorted(i.path for i in infos if i.base_name.endswith(".parquet") and i.base_name[0] not in "._")


def expire(path: str, oldest: int) -> None:
    """Forget the history before oldest; the mails stay."""
    system, where = _system(path)
    with system.open_output_stream(f"{where}/_expired") as f:
        f.write(json.dumps(oldest).encode())


def _expired(path: str) -> int:
    from pyarrow import fs

    system, where = _system(path)
    if system.get_file_info(f"{where}/_expired").type == fs.FileType.NotFound:
        return -1
    with system.open_input_stream(f"{where}/_expired") as f:
        return json.loads(f.read())


#: (column, comparison, value): all must hold.
Term = tuple[str, str, object]
_TESTS: dict[str, Callable] = {
    "=": lambda a, v: a == v,
    ">": lambda a, v: a > v,
    ">=": lambda a, v: a >= v,
    "<": lambda a, v: a < v,
    "<=": lambda a, v: a <= v,
    "in": lambda a, v: a in v,
    "contains": lambda a, v: v in a,
    "ends": lambda a, v: a.endswith(v),
    "like": lambda a, v: re.search(v, a, re.I) is not None,
}


@dataclass
class Page(InputPartition):
    file: str
    group: int
    terms: list[Term]


def _possible(terms: list[Term], column: str, low, high) -> bool:
    """Whether a page whose column lies between low and high can hold a mail for which all terms hold."""
    for name, test, value in terms:
        if name == column and (test in ("=", ">", ">=") and not _TESTS[">" if test == ">" else ">="](high, value) or test in ("=", "<", "<=") and not _TESTS["<" if test == "<" else "<="](low, value)):
            return False
    return True


def pages(path: str, terms: list[Term]) -> list[Page]:
    """The pages that may hold what is asked for, by the statistics in their files' footers."""
    import pyarrow.parquet as pq

    system, files = _files(path)
    out = []
    for file in files:
        meta = pq.read_metadata(file, filesystem=system)
        places = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for group in range(meta.num_row_groups):
            spans = {c: meta.row_group(group).column(places[c]).statistics for c in ("history_id", "arrived_at")}
            if all(s is None or not s.has_min_max or _possible(terms, c, s.min, s.max) for c, s in spans.items()):
                out.append(Page(file, group, terms))
    return out


def newest(path: str) -> dict:
    """The newest history and its time, from footers alone."""
    import pyarrow.parquet as pq

    system, files = _files(path)
    best = {"history": -1, "at": 0}
    for file in files:
        meta = pq.read_metadata(file, filesystem=system)
        places = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for group in range(meta.num_row_groups):
            top = {c: meta.row_group(group).column(places[c]).statistics.max for c in ("history_id", "arrived_at")}
            best = {"history": max(best["history"], top["history_id"]), "at": max(best["at"], top["arrived_at"])}
    return best


def _held(heads, terms: list[Term]):
    """Which of the mails all terms hold for, as a mask."""
    import numpy as np

    kept = np.ones(heads.num_rows, bool)
    for name, test, value in terms:
        column = heads.column(name).to_pylist()
        holds = {x: x is not None and _TESTS[test](x, value) for x in {column[i] for i in np.flatnonzero(kept)}}
        kept &= [holds.get(x, False) for x in column]
    return kept


def _fetched(path: str, page: Page) -> Iterator:
    """A page's mails: headers first, bodies only if any of its mails counts. Of either some are held at a time, however large the page."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    system, _ = _system(path)
    with system.open_input_file(page.file) as f:
        file = pq.ParquetFile(f, pre_buffer=False, buffer_size=1 << 20)
        some = lambda columns: file.iter_batches(batch_size=HELD, row_groups=[page.group], columns=columns)
        kept = np.concatenate([np.zeros(0, bool), *[_held(heads, page.terms) for heads in some(_HEADERS)]])
        at = 0
        for mails in some([*_HEADERS, *_BODIES]) if kept.any() else ():
            wanted, at = kept[at : at + mails.num_rows], at + mails.num_rows
            if wanted.any():
                yield from pa.Table.from_batches([mails]).select([*_HEADERS, *_BODIES]).filter(pa.array(wanted)).combine_chunks().to_batches(max_chunksize=1000)


class MailReader(DataSourceReader):
    def __init__(self, path: str, terms: list[Term]):
        self.path, self.terms = path, terms

    def pushFilters(self, filters: list) -> Iterator:
        """Take over what pages and headers can tell; the rest is Spark's."""
        tests = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", StringContains: "contains", StringEndsWith: "ends"}
        for f in filters:
            test = tests.get(type(f))
            if test and f.attribute in (("sender",), ("arrived_at",), ("history_id",)):
                self.terms.append((f.attribute[0], test, tuple(f.value) if test == "in" else f.value))
            else:
                yield f

    def partitions(self) -> list[Page]:
        return pages(self.path, self.terms)

    def read(self, partition: Page) -> Iterator:
        return _fetched(self.path, partition)


class MailStream(DataSourceStreamReader):
    def __init__(self, path: str, terms: list[Term]):
        self.path, self.terms = path, terms

    def initialOffset(self) -> dict:
        return {"history": -1, "at": 0}

    def latestOffset(self) -> dict:
        return newest(self.path)

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if start["history"] >= end["history"]:
            return []
        upto: list[Term] = [*self.terms, ("history_id", "<=", end["history"])]
        if 0 <= start["history"] < _expired(self.path):
            return pages(self.path, [*upto, ("arrived_at", ">=", start["at"] - OVERLAP_MS)])
        return pages(self.path, [*upto, ("history_id", ">", start["history"])])

    def read(self, partition: Page) -> Iterator:
        return _fetched(self.path, partition)


class Mailbox(DataSource):
    """Format `mailbox`: option `path`, and `senders`, a pattern of senders that count (all without it)."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return MAIL

    def _terms(self) -> list[Term]:
        return [("sender", "like", self.options["senders"])] if self.options.get("senders") else []

    def reader(self, schema: StructType) -> MailReader:
        return MailReader(self.options["path"], self._terms())

    def streamReader(self, schema: StructType) -> MailStream:
        return MailStream(self.options["path"], self._terms())


def registered(spark: SparkSession) -> SparkSession:
    """A session of the same cluster that knows the format and hands it filters."""
    session = spark.newSession()
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        session.dataSource.register(Mailbox)
    except AnalysisException as e:  # another session of this process may have told the cluster already
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
    return session


def mail(session: SparkSession, path: str, senders: str = KNOWN) -> DataFrame:
    return session.read.format("mailbox").option("path", path).option("senders", senders).load()


def mail_stream(session: SparkSession, path: str, senders: str = KNOWN) -> DataFrame:
    return session.readStream.format("mailbox").option("path", path).option("senders", senders).load()


def _cursor(spark: SparkSession, cursor: str) -> int:
    if not exists(spark, cursor):
        return -1
    return spark.read.schema("history long").json(cursor).agg(F.max("history")).first()[0]


def sync(session: SparkSession, path: str, out: str, cursor: str, budget_s: float, step: int, senders: str = KNOWN, clock: Callable[[], float] = time.monotonic, buckets: int = BUCKETS) -> bool:
    """Append the mails that have come since the cursor to the table at out, a stretch of history a step, until all is there
    or the time is used up; returns whether all is there.

    The end is taken before anything is read. A step's rows are written before the cursor moves on, and a step that is cut between
    the two is repeated without effect, so a later run goes on where this one stopped.
    """
    deadline, end, at = clock() + budget_s, newest(path)["history"], _cursor(session, cursor)
    if at < end and at < 0:
        at = mail(session, path, "").agg(F.min("history_id")).first()[0] - 1
    while at < end:
        if clock() > deadline:
            return False
        to = min(at + step, end)
        batch = mail(session, path, senders).filter((F.col("history_id") > at) & (F.col("history_id") <= to))
        append_once(batch, out, ["user_id", "message_id"], buckets)
        session.createDataFrame([(to,)], "history long").coalesce(1).write.mode("append").json(cursor)
        at = to
    return True
