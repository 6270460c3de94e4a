"""Knowledge bases: projection of sources, batches, unique keys, storage and search."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.scorers import PairScorer
from lorekeep.functions.text import DEFAULT_DIM
from lorekeep.operators import blocks, ivf, listjoin
from lorekeep.operators.embed import HASH_DIM, hash_bags
from lorekeep.operators.limits import first_rows
from lorekeep.operators.rerank import rerank
from lorekeep.operators.search import BAG, LOOKUP_BYTES, VectorKind, fetch, maybe_wanted, search
from lorekeep.session import checkpointed, new_dir, stored_table, union_all

RESERVED = ("id", "content", "vector", "batch_id", "feed", "ingest_ts")


@dataclass(frozen=True)
class KnowledgeBaseSpec:
    """Which source columns become id, content and metadata (``{kb name: source name}``)."""

    id_column: str
    content_columns: tuple[str, ...]
    metadata: Mapping[str, str] = field(default_factory=dict)
    dim: int = DEFAULT_DIM

    def __post_init__(self) -> None:
        names = self.content_columns
        names = names.split(",") if isinstance(names, str) else names
        object.__setattr__(self, "content_columns", tuple(dict.fromkeys(n.strip() for n in names)))
        if not self.id_column:
            raise ValueError("a knowledge base needs an id column")
        if not any(self.content_columns):
            raise ValueError("a knowledge base needs at least one content column")
        clash = set(self.metadata) & set(RESERVED)
        if clash:
            raise ValueError(f"metadata names {sorted(clash)} are reserved")

    def source_columns(self) -> list[str]:
        """Needed source columns, each once, in first-use order."""
        wanted = [self.id_column, *self.content_columns, *self.metadata.values()]
        return list(dict.fromkeys(wanted))


def compose_content(columns: Sequence[str]) -> Column:
    """Content columns joined by newlines, skipping NULLs; NULL when all are NULL."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    some = F.coalesce(*[F.col(c).cast("string") for c in columns])
    return F.when(some.isNotNull(), F.concat_ws("\n", *columns))


def project_source(source: DataFrame, spec: KnowledgeBaseSpec) -> DataFrame:
    """``id, content, <metadata>`` of a source; rows without any content are left out."""
    missing = [c for c in spec.source_columns() if c not in source.columns]
    if missing:
        raise ValueError(f"source lacks columns {missing}")
    return source.select(
        F.col(spec.id_column).alias("id"),
        compose_content(spec.content_columns).alias("content"),
        *[F.col(src).alias(dst) for dst, src in spec.metadata.items()],
    ).filter(F.col("content").isNotNull())


def newest(source: DataFrame, limit: int | None, order_column: str = "id") -> DataFrame:
    """The ``limit`` rows with the highest ``order_column``; no positive limit keeps all."""
    if not limit or limit < 1:
        return source
    return first_rows(source, [F.desc(order_column)], limit)


def one_row_per_id(rows: DataFrame) -> DataFrame:
    """One row per id within a batch; rows without an id all stay.

    Only ids are grouped at first. Rows whose id does not repeat are then written from the scan
    without a shuffle. Among the others the rank filter works ahead of the shuffle, so a hot id
    sends one row per task. The last row by content, then by the other columns, wins.
    """
    repeated = checkpointed(rows.groupBy("id").count().filter("count > 1").select("id"))
    if repeated.isEmpty():
        return rows
    others = [F.desc(F.to_json(F.struct(c))) for c in rows.columns if c not in ("id", "content")]
    order = Window.partitionBy("id").orderBy(F.desc("content"), *others)
    picked = rows.join(repeated, "id", "left_semi").withColumn("_n", F.row_number().over(order))
    single = rows.join(repeated, "id", "left_anti")
    return union_all([single, picked.filter("_n = 1").drop("_n")])


def latest_rows(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """The latest row of every id; ``repeated`` names at least all ids that several batches hold.

    Only these ids are looked up and only their small stored table meets the rows: Spark
    broadcasts it where it is small, and no content is shuffled then.
    """
    batch = F.struct("batch_id", "feed")
    keep = rows.select("id", batch.alias("batch")).join(repeated, "id", "left_semi")
    keep = checkpointed(keep.groupBy("id").agg(F.max("batch").alias("_keep")))
    joined = rows.join(keep, "id", "left")
    return joined.filter(F.col("_keep").isNull() | (F.col("_keep") == batch)).drop("_keep")


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is one of the stored ``ids``, which are broadcast while they are few; beyond, bits of bounded size thin the rows before they are shuffled."""
    if ids.count() * 64 <= LOOKUP_BYTES:
        return rows.join(F.broadcast(ids), "id", "left_semi")
    return maybe_wanted(rows, ids).join(ids, "id", "left_semi")


def without_removed(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows that no removal of their own or a later batch names."""
    batch = F.struct(F.col("batch_id").cast("bigint").alias("batch_id"), F.col("feed").cast("string").alias("feed"))
    last = checkpointed(removed.groupBy("id").agg(F.max(batch).alias("_removed")))
    small = last.count() * 96 <= LOOKUP_BYTES
    joined = rows.join(F.broadcast(last) if small else last, "id", "left")
    return joined.filter(F.col("_removed").isNull() | (batch > F.col("_removed"))).drop("_removed")


Embedder = Callable[[DataFrame, str], DataFrame]


class Base:
    """Rows to search with the way their vectors were made and are compared.

    ``embedder`` adds a ``vector`` column for a text column (default: bags of hashed terms of
    ``dim`` buckets) and ``kind`` says how such vectors are compared. A ``reranker`` (scorer of
    question and content columns) turns on a second stage over ``overfetch`` times as many
    candidates. Everything that asks a base goes through it, so questions are always embedded
    and compared as its rows were.
    """

    def __init__(
        self,
        spark: SparkSession,
        dim: int = DEFAULT_DIM,
        embedder: Embedder | None = None,
        kind: VectorKind = BAG,
        reranker: PairScorer | None = None,
        overfetch: int = 4,
    ) -> None:
        self.spark, self.dim = spark, dim
        self.embedder, self.kind = embedder, kind
        self.reranker, self.overfetch = reranker, overfetch

    def rows(self) -> DataFrame:
        """``id, content, vector`` and metadata."""
        raise TypeError("a base needs rows")

    def embed(self, texts: DataFrame, column: str = "question") -> DataFrame:
        if self.embedder is not None:
            return self.embedder(texts, column)
        return hash_bags(texts, column, self.dim)

    def score(
        self,
        questions: DataFrame,
        k: int | None = 5,
        filters: Mapping[str, Any] | None = None,
        rows: DataFrame | None = None,
    ) -> DataFrame:
        """``question_id, id, score`` and, with a positive ``k``, ``rank``: one row per hit.

        With a reranker the score column is that of the second stage.
        """
        rows = self.rows() if rows is None else rows
        asked = self.embed(questions.select("question_id", "question")).select("question_id", "vector")
        if self.reranker is None or not k or k < 1:
            return search(rows, asked, k, filters, self.kind)
        found = search(rows, asked, k * self.overfetch, filters, self.kind)
        return rerank(found, questions, rows, k, self.reranker).withColumnRenamed("rerank_score", "score")

    def search(
        self,
        questions: DataFrame,
        k: int | None = 5,
        filters: Mapping[str, Any] | None = None,
        columns: Sequence[str] = ("content",),
    ) -> DataFrame:
        """``question_id, id, <columns>, score, rank`` for ``question_id, question`` rows.

        With a reranker the score column is ``rerank_score``. Without a positive ``k`` every
        match is returned and there is no ``rank``.
        """
        rows = self.rows()
        hits = self.score(questions, k, filters, rows)
        if self.reranker is not None and k and k > 0:
            hits = hits.withColumnRenamed("score", "rerank_score")
        return fetch(hits, rows, columns) if columns else hits

    def query(
        self,
        text: str,
        filters: Mapping[str, Any] | None = None,
        limit: int | None = 5,
        columns: Sequence[str] = ("content",),
    ) -> DataFrame:
        """One question: the batch form with a single row."""
        question = self.spark.createDataFrame([(0, text)], "question_id bigint, question string")
        return self.search(question, limit, filters, columns).drop("question_id")


class FrameBase(Base):
    """A base over a frame with ``id, content, vector`` and metadata columns.

    The frame's vectors must have been made as the options say. Bags need their dimension: that of ``hash_bags``
    is known from its column, for others ``dim`` names it. A ``dim`` that is not the column's raises.
    """

    def __init__(self, frame: DataFrame, dim: int | None = None, **options: Any) -> None:
        if options.get("embedder") is None and not options.get("kind", BAG).dense:
            known = frame.schema["vector"].metadata.get(HASH_DIM)
            if dim is None and known is None:
                raise ValueError("the frame's bags do not name their dimension: give dim")
            if known is not None and dim not in (None, known):
                raise ValueError(f"the frame's bags have {known} buckets, not {dim}")
            dim = dim or known
        super().__init__(frame.sparkSession, dim or DEFAULT_DIM, **options)
        self.frame = frame

    def rows(self) -> DataFrame:
        return self.frame


COMPACTED = "compacted"


class KnowledgeBase(Base):
    """A base stored under ``path``: one folder per batch of a feed, vectors beside the content.

    A batch is known by its feed and number: writing it again replaces it, so a retried load
    changes nothing, and feeds with numbers of their own do not meet. Of one id the row of the
    highest batch number wins (ties: the feed's name that sorts last). Ids that occur in several batches are noted when
    a batch is written, so reading costs one look-up of these, however many batches there are. Removals are notes by batch too.
    How vectors were made is stored with the first batch; opening the folder otherwise raises. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, spec: KnowledgeBaseSpec, **options: Any) -> None:
        super().__init__(spark, spec.dim, **options)
        self.path, self.spec, self.options = path.rstrip("/"), spec, options
        self.data, self.repeats, self.removed = f"{self.path}/rows", f"{self.path}/_repeats", f"{self.path}/_removed"
        self.checked = False

    def _made(self) -> dict[str, Any]:
        name = None if self.embedder is None else getattr(self.embedder, "__qualname__", type(self.embedder).__qualname__)
        return {"dim": self.spec.dim if self.embedder is None else None, "dense": self.kind.dense, "embedder": name}

    def check(self) -> bool:
        """Whether the base has been written; raises if its vectors were made in another way."""
        if not self.checked:
            stored = stored_table(self.spark, f"{self.path}/_made", "made string")
            if stored is None:
                return False
            known = json.loads(stored.first()["made"])
            if known != self._made():
                raise ValueError(f"the base was made with {known}, not {self._made()}")
            self.checked = True
        return True

    def append(self, source: DataFrame, batch_id: int, limit: int | None = None, feed: str = "main") -> None:
        """Project, embed and store a batch."""
        if feed == COMPACTED or not re.fullmatch(r"\w+", feed):
            raise ValueError("a feed is named by letters, digits and underscores, and not as compactions are")
        newest_rows = newest(source.select(*self.spec.source_columns()), limit, self.spec.id_column)
        rows = one_row_per_id(project_source(newest_rows, self.spec))
        self._note_repeats(rows.select("id"), feed, batch_id)
        rows = self.embed(rows, "content").withColumn("ingest_ts", F.current_timestamp())
        self._write(rows, self.data, feed, batch_id)

    def _note_repeats(self, ids: DataFrame, feed: str, batch_id: int) -> None:
        """Note the ids that other batches hold before the rows can be read, so no reader sees one twice.

        Stored ids meet the batch's ids where they lie: these are broadcast, or a filter of bounded size thins the
        stored ones first. Notes only grow; one id too many costs a look-up.
        """
        stored = stored_table(self.spark, self.data)
        if stored is None:
            return
        own = (F.col("feed") == feed) & (F.col("batch_id") == batch_id)
        again = among(stored.filter(~own).select("id"), checkpointed(ids.distinct()))
        again.distinct().write.mode("append").parquet(f"{self.repeats}/feed={feed}/batch_id={batch_id}")

    def delete(self, ids: DataFrame, batch_id: int, feed: str = "main") -> None:
        """Remove the rows of ``ids`` (column ``id``) in all batches up to this one, which has a number like an append.

        Rows of later batches come back; a retried delete replaces its note. Rows of a batch of the same number and feed go too.
        """
        noted = ids.select("id").filter("id IS NOT NULL").distinct()
        noted.write.mode("overwrite").parquet(f"{self.removed}/feed={feed}/batch_id={batch_id}")

    def _write(self, rows: DataFrame, data: str, feed: str, batch_id: int) -> None:
        """Bloom filters on the id let a lookup of few hits skip most row groups."""
        if not self.check():
            made = self.spark.createDataFrame([(json.dumps(self._made()),)], "made string")
            made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_made")
        path = f"{data}/feed={feed}/batch_id={batch_id}"
        rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true").parquet(path)

    def all_rows(self) -> DataFrame:
        """Every stored row of every batch."""
        self.check()
        rows = self.spark.read.parquet(self.data)
        return rows.withColumns({"batch_id": F.col("batch_id").cast("bigint"), "feed": F.col("feed").cast("string")})

    def rows(self) -> DataFrame:
        """The current row of every id."""
        rows, repeated, removed = self.all_rows(), stored_table(self.spark, self.repeats), stored_table(self.spark, self.removed)
        if repeated is not None and not repeated.isEmpty():
            rows = latest_rows(rows, repeated.select("id").distinct())
        return rows if removed is None else without_removed(rows, removed)

    def compact(self, path: str | None = None) -> KnowledgeBase:
        """Write the current rows to a new folder and return the base there.

        They become a batch that no append replaces and that every other batch supersedes.
        """
        base = KnowledgeBase(self.spark, path or new_dir(self.spark, "kb"), self.spec, **self.options)
        base._write(self.rows().drop("batch_id", "feed"), base.data, COMPACTED, -1)
        return base

    def register(self, name: str) -> None:
        """Make the current rows readable by SQL as ``name``."""
        self.rows().createOrReplaceTempView(name)

    def query(
        self,
        text: str,
        filters: Mapping[str, Any] | None = None,
        limit: int | None = 5,
        columns: Sequence[str] | None = None,
    ) -> DataFrame:
        """One question, by default with content and metadata of its hits."""
        return super().query(text, filters, limit, ["content", *self.spec.metadata] if columns is None else columns)

    def index_path(self) -> str:
        return f"{self.path}/{'_ivf' if self.kind.dense else '_blocks'}"

    def index(self, lists: int | None = None) -> None:
        """Build the index of the base or bring it up to date: an inverted file of dense vectors, postings in blocks
        of bags, which are written anew with a copy of ids and bags. Weighted bags are not indexed."""
        if not self.kind.dense:
            if self.kind != BAG:
                raise ValueError("postings hold plain bags, not weighted ones")
            bags = self.rows().select("id", "vector")
            path = f"{self.index_path()}/{uuid.uuid4().hex}"
            bags.write.parquet(f"{path}/rows")
            indexed = self.spark.read.parquet(f"{path}/rows")
            blocks.build_blocks(indexed, path)
            self.spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_indexed")
            return
        rows = self.rows().drop("content", "batch_id", "feed", "ingest_ts")
        if stored_table(self.spark, f"{self.index_path()}/centres") is None:
            ivf.build_index(rows, self.index_path(), lists)
        else:
            ivf.refresh_index(rows, self.index_path())

    def search_indexed(
        self,
        questions: DataFrame,
        k: int = 5,
        filters: Mapping[str, Any] | None = None,
        nprobe: int | None = None,
        join: bool = False,
    ) -> DataFrame:
        """``question_id, id, score, rank`` from the index as it was last brought up to date.

        With ``join`` questions, however many, meet an inverted file by lists (exact, so without ``nprobe``).
        """
        asked = self.embed(questions.select("question_id", "question")).select("question_id", "vector")
        if not self.kind.dense:
            if filters is not None or nprobe is not None or join:
                raise ValueError("the postings of a base take neither filters nor probes nor joins; search() filters")
            path = self.spark.read.parquet(f"{self.path}/_indexed").first()["path"]
            return blocks.search_blocks(self.spark, path, self.spark.read.parquet(f"{path}/rows"), asked, k)
        if join:
            if nprobe is not None:
                raise ValueError("a join by lists is exact and takes no nprobe")
            return listjoin.search_join(self.spark, self.index_path(), asked, k, filters)
        return ivf.search_index(self.spark, self.index_path(), asked, k, nprobe, filters)
