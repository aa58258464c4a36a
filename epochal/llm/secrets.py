"""Secret scans by corpus-wide ownership frequency.

Patterns give candidate values. Each value is hashed at once (the scan's output holds no value in clear) and counted over the
corpus by distinct repositories and owners: a value that many owners or many repositories hold is a copied example, whatever it
looks like; a value that one or two owners hold in a few repositories and that looks random is taken for a live credential. Those
values become spans of kind live.

Owners and repositories are columns the caller names. `documents` has no repository, so the query takes the source for the owner
and the document for the repository.

Defined cases: a null text counts as empty; a null owner is an owner; repeated rows are rows of their own, but one repository; an
empty table gives an empty result. A document without spans has zero counts, the digest of the empty string and an empty list.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm.common import materialize, spread, table, unused

#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ["assign", "access", "hex", "live"]
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Parts of values that stand for a secret in manuals and tests.
PLACEHOLDERS = re.compile(r"example|sample|change_?me|your|dummy|placeholder|test|xxxx|1234567|(.)\1{5}", re.IGNORECASE)
#: A live value is at least so long, has so many bits a character, and fewer owners and fewer repositories than a copied example.
LIVE_LENGTH, LIVE_BITS, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 16, 3.0, 3, 10
#: Parts into which the rows with one value are dealt.
SALTS = 32

SCANNED = """n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string,
spans array<struct<start:bigint,kind:int,end:bigint>>, found array<struct<value:string,start:bigint,end:bigint>>"""


def spans_of(text: str) -> list[tuple[int, int, int, int, int]]:
    """start, kind, end, start and end of the value: of every base span, by start and kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGN:
            out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def looks_live(value: str) -> bool:
    """Long, random by its letters' frequencies, and no placeholder."""
    if len(value) < LIVE_LENGTH or PLACEHOLDERS.search(value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LIVE_BITS


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def digest_of(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def mapped(df: DataFrame, schema: str, row) -> DataFrame:
    """The columns of df but the last, which is a text, and those that row makes of the text (and of the row's other values)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(schema)
    kinds = [f.type for f in to_arrow_schema(made)]
    kept, names = len(df.columns) - 1, df.columns[:-1] + made.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = zip(*(row(*x) for x in zip(*(c.to_pylist() for c in batch.columns))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array(c, k) for c, k in zip(rows, kinds))], names)

    return df.mapInArrow(run, StructType([*df.schema.fields[:-1], *made.fields]))


def scan_row(rid, doc_id, owner, repository, text: str | None) -> tuple:
    text = text or ""
    spans = spans_of(text)
    kinds = Counter(s[1] for s in spans)
    values = {(a, b): text[a:b] for *_, a, b in spans}
    found = [{"value": digest_of(v), "start": a, "end": b} for (a, b), v in values.items() if looks_live(v)]
    flat = [{"start": s[0], "kind": s[1], "end": s[2]} for s in spans]
    return kinds[0], kinds[1], kinds[2], hashlib.sha256(joined(spans).encode()).hexdigest(), flat, found


def scanned(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """rid (a number for each row), doc_id, owner, repository, the base spans of the text and the values that look live. Written
    to the shared folder, so that numbers stay as they are."""
    keyed = spread(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), "text")
    return materialize(mapped(keyed, SCANNED, scan_row), "scanned")


def owned_values(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """value, owners, repositories: of the values with fewer owners and fewer repositories than a copied example. found: value, owner, repository. Each
    step keeps one row per key and task before it shuffles, so a value on a third of all rows costs no more than others."""
    once = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = once.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    counts = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    return counts.filter((F.col("owners") < example_owners) & (F.col("repositories") < example_repositories))


def live_spans(base: DataFrame) -> DataFrame:
    """rid, doc_id, value, start, end of every live value. The rows with one value are dealt over many tasks."""
    found = base.filter(F.size("found") > 0).select("rid", "doc_id", "owner", "repository", F.inline("found"))
    verdicts = owned_values(found).select("value", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    # by shuffle: the verdicts grow with the corpus, which the planner can't see
    return salted.join(verdicts.hint("merge"), ["value", "salt"]).select("rid", "doc_id", "value", "start", "end")


def secret_spans(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live: one row per input row."""
    base = scanned(docs, owner, repository)
    live = live_spans(base).groupBy("rid").agg(F.collect_set(F.struct("start", F.lit(3).alias("kind"), "end")).alias("live"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    every = F.array_sort(F.concat("spans", F.coalesce("live", none)))
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return base.join(live, "rid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"))


def redacted(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """docs with every live value in its own text replaced by the mark, those that overlap by one; columns and rows stay, n_chars
    follows if there is one. Rows are numbered and written once, and the values of a row are joined by its number."""
    number, values = unused(docs, "number", "values")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    base = scanned(numbered.select(F.col(number).alias("doc_id"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), "text"), "owner", "repository")
    live = live_spans(base).groupBy(F.col("doc_id").alias(number)).agg(F.collect_set("value").alias(values))

    def row(*values) -> tuple:
        live, text = values[-2:]
        if not live or not text:
            return (text,)
        owned, at, out = set(live), 0, []
        for a, b in sorted({(a, b) for *_, a, b in spans_of(text)}):
            if digest_of(text[a:b]) in owned:
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
        return ("".join([*out, text[at:]]),)

    marked = numbered.join(live.hint("merge"), number, "left")
    rest = [c for c in docs.columns if c != "text"]
    out = mapped(marked.select(*rest, values, "text"), "text string", row).drop(values)
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(docs.columns)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"), "source", "doc_id")
