"""Duplicates hidden by formatting: one row per distinct record, with its number of copies.

Method: a record is written as canonical bytes (letters, marks and digits in one case, fields in one order). Equal
records are first combined inside each task. The combined records are then partitioned recursively by the bytes of
their canonical form: a bucket that holds more than `limit` of them is split by its next bytes, until each fits (or
its records are equal). Each bucket is counted in a trie whose terminal nodes hold the number of copies and the
smallest id.

Scale: a record with a third of all rows is one entry per task after combining. One count gives the sizes of the
buckets at several depths at once, so that a job for further depths runs only for keys that share so many bytes. The
driver sees only the prefixes of oversized buckets, at most rows / limit of them at each depth. The buckets of a
partition come sorted, one after the other, and each trie is given out and dropped when its bucket ends: a task holds
one trie, of at most `limit` records and their copies from each task. Copies find their first id by a digest of 128
bits; records with more than `hot` copies are spread over salts for that.

Defined results: null text counts as none; a record without any letter or digit is no record and has no copies.
Invalid JSON counts by its letters and digits. Rows that repeat an id count as copies but give one link.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.llm.words import oversized
from sutraloom.runtime import cut_lineage

#: Distinct records that one bucket may hold.
LIMIT = 50_000
#: Copies beyond which a record is spread over salts.
HOT = 100_000
#: Bytes by which a level splits.
STEP = 2
#: Counted records that a task hands on together.
HANDED = 10_000
_FIELD, _PAIR = "\x1f", "\x1e"
_NAME_ENDS = re.compile(r"[()/;,]")


def solid(text: str | None) -> str:
    """Letters, marks and digits of a text in one case and composition."""
    if not text:
        return ""
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return folded if folded.isalnum() else "".join([c for c in folded if c.isalnum() or unicodedata.category(c)[0] == "M"])


def canonical_entry(term: str | None, fields: str | None) -> bytes | None:
    """A term with a JSON object: the object's names and values in any order."""
    pairs = []
    if fields and fields.strip():
        try:
            found = json.loads(fields, object_pairs_hook=lambda p: p)
            pairs = sorted(f"{solid(str(k))}={solid(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))}" for k, v in found)
        except (ValueError, TypeError):
            pairs = [solid(fields)]
    whole = solid(term) + _FIELD + _PAIR.join(pairs)
    return whole.encode() if len(whole) > 1 else None


def canonical_names(text: str | None) -> bytes | None:
    """The set of names in a text in which brackets, slashes, semicolons and commas part the names."""
    names = sorted({s for part in _NAME_ENDS.split(text or "") if (s := solid(part))})
    return _PAIR.join(names).encode() if names else None


def with_key(df: DataFrame, row_id: str, columns: list[str], canonical: Callable[..., bytes | None], tab: str) -> DataFrame:
    """(tab, id, key, digest) of each row that is a record. Nothing else of df is read, whatever its columns."""
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for i, *parts in zip(*(b.column(j).to_pylist() for j in range(width + 1))):
                if i is not None and (k := canonical(*parts)) is not None:
                    ids.append(i)
                    keys.append(k)
            digests = [xxhash.xxh3_128_digest(tab.encode() + b"\x00" + k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tab] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(digests, pa.binary())],
                names=["tab", "id", "key", "digest"],
            )

    return df.select(F.col(row_id).cast("bigint"), *columns).mapInArrow(run, "tab string, id bigint, key binary, digest binary")


def combine(rows: DataFrame) -> DataFrame:
    """(tab, key, digest, n, first_id), equal records of a task combined (and not yet across tasks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bytes], list] = {}

        def give() -> pa.RecordBatch:
            v = list(seen.values())
            made = pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.binary()), pa.array([x[0] for x in v], pa.binary()), pa.array([x[1] for x in v], pa.int64()), pa.array([x[2] for x in v], pa.int64())],
                names=["tab", "key", "digest", "n", "first_id"],
            )
            seen.clear()
            return made

        for b in batches:
            for tab, i, key, digest in zip(*(b.column(j).to_pylist() for j in range(4))):
                at = seen.get((tab, key))
                if at is None:
                    seen[tab, key] = [digest, 1, i]
                else:
                    at[1] += 1
                    at[2] = min(at[2], i)
            if len(seen) > 4 * LIMIT:
                yield give()
        yield give()

    return rows.mapInArrow(run, "tab string, key binary, digest binary, n bigint, first_id bigint")


class Counter:
    """A trie over bytes with counters at the ends; single branches are kept as one edge."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.ends: list[list] = []

    def add(self, key: bytes, payload: tuple, n: int, first: int) -> None:
        node = self.root
        for i in range(0, len(key), 8):
            node = node.setdefault(key[i : i + 8], {})
        end = node.get(None)
        if end is None:
            node[None] = end = [payload, n, first]
            self.ends.append(end)
        else:
            end[1] += n
            end[2] = min(end[2], first)


def count_records(rows: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """(tab, digest, key, n_copies, first_id): one row per distinct record of `with_key` rows."""
    combined = cut_lineage(combine(rows))
    split = rows.sparkSession.sparkContext.broadcast(frozenset(oversized(combined, "key", limit, step, step)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep = split.value
        for b in batches:
            at = []
            for tab, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                depth = step
                while key[:depth] in deep and depth < len(key):
                    depth += step
                at.append(tab.encode() + b"\x00" + key[:depth])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.binary())], names=[*b.schema.names, "bucket"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now, head, done = Counter(), None, 0, []
        for b in batches:
            for tab, key, digest, n, first, at in zip(*(b.column(j).to_pylist() for j in range(6))):
                if at != now:
                    done += trie.ends
                    if len(done) >= HANDED:
                        yield _counted(done)
                        done = []
                    trie, now, head = Counter(), at, len(at) - len(tab.encode()) - 1
                trie.add(key[head:], (tab, digest, key), n, first)
        yield _counted(done + trie.ends)

    placed = combined.mapInArrow(place, "tab string, key binary, digest binary, n bigint, first_id bigint, bucket binary")
    in_order = placed.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return in_order.mapInArrow(count, "tab string, digest binary, key binary, n_copies bigint, first_id bigint")


def _counted(e: list[list]) -> pa.RecordBatch:
    columns = [pa.array([x[0][i] for x in e], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))]
    columns += [pa.array([x[i] for x in e], pa.int64()) for i in (1, 2)]
    return pa.RecordBatch.from_arrays(columns, names=["tab", "digest", "key", "n_copies", "first_id"])


def find_copies(rows: DataFrame, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """(tab, first_id, copy_id) of each row that is a copy of an earlier one."""
    rows = cut_lineage(rows)
    classes = cut_lineage(count_records(rows, limit).where(F.col("n_copies") > 1).select("digest", "first_id", "n_copies"))
    salts = F.ceil(F.col("n_copies") / F.lit(hot)).cast("int")
    hot_ones = classes.where(F.col("n_copies") > hot).select("digest", salts.alias("salts"))
    n_hot = hot_ones.count()
    if n_hot:  # at most rows / hot of them
        if n_hot > 1_000_000:
            raise ValueError("raise `hot`: too many records have more copies than that")
        rows = rows.join(F.broadcast(hot_ones), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
        classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        joined = rows.select("tab", "id", "digest", "salt").join(classes, ["digest", "salt"])
    else:
        joined = rows.select("tab", "id", "digest").join(classes, "digest")
    return joined.where(F.col("id") > F.col("first_id")).select("tab", "first_id", F.col("id").alias("copy_id")).distinct()


FOUND_SQL = r"""
WITH entries AS (
  SELECT entry_id AS id, lower(regexp_replace(nfc_normalize(coalesce(sanskrit_term, '')), '[^\p{L}\p{M}\p{N}]', '', 'g')) || chr(31) || coalesce((
    SELECT string_agg(x.pair, chr(30) ORDER BY x.pair) FROM (
      SELECT lower(regexp_replace(nfc_normalize(j.key), '[^\p{L}\p{M}\p{N}]', '', 'g')) || '=' ||
             lower(regexp_replace(nfc_normalize(coalesce(j.value ->> '$', '')), '[^\p{L}\p{M}\p{N}]', '', 'g')) AS pair
      FROM json_each(g.entry_json) j) x), '') AS key
  FROM sanskrit_glossary g
), parts AS (
  SELECT term_id AS id, lower(regexp_replace(nfc_normalize(p), '[^\p{L}\p{M}\p{N}]', '', 'g')) AS part
  FROM (SELECT term_id, unnest(regexp_split_to_array(sanskrit_ayurvedic_terms, '[()/;,]')) AS p
        FROM ayurveda_terms_from_ak WHERE sanskrit_ayurvedic_terms IS NOT NULL)
), names AS (
  SELECT id, string_agg(DISTINCT part, chr(30) ORDER BY part) AS key FROM parts WHERE part <> '' GROUP BY id
), keyed AS (
  SELECT 'sanskrit_glossary' AS tab, id, key FROM entries WHERE length(key) > 1
  UNION ALL SELECT 'ayurveda_terms_from_ak', id, key FROM names
)
SELECT tab, first_id, id AS copy_id FROM (SELECT tab, id, min(id) OVER (PARTITION BY tab, key) AS first_id FROM keyed) WHERE id > first_id
"""

RECORDS_SQL = FOUND_SQL.rsplit("SELECT tab, first_id", 1)[0] + "SELECT tab, min(id) AS first_id, count(*) AS n_copies FROM keyed GROUP BY tab, key"
