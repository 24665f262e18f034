"""Per-session reuse of the derived collection and the shared first stage.

Several registered queries start from the same derived tables (corpus,
topics, judgments) and the same BM25 first stage. A ``Workspace`` builds
each of them once per (session, input folder). The small ones (topics,
judgments, a top-k run) are cached, the deep ones (all methods' runs,
the metrics table) checkpointed to the shared folder; the corpus stays a
lazy scan so column pruning and pushdown reach Parquet for every consumer.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.text import tokens
from ..operators import dense, lexical, multivector, textprep
from ..sources import collection as coll
from ..sources.store import bucketed, fingerprint, is_bucketed, materialize, segments, stored_count
from .sizing import release, settled, spread_small

_WORKSPACES: dict = {}


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str, variant: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.variant = variant  # one wording only, or all

    def only(self, variant: str, fresh: bool = False) -> Workspace:
        """A workspace of one wording over the same stored index; ``fresh``: with nothing kept."""
        key = ("only", variant)
        if fresh or key not in self.__dict__:
            own = Workspace(self.spark, self.sf_dir, variant)
            self.state("documents")
            own.__dict__ |= {"index": self.index, ("state", "documents"): self.__dict__[("state", "documents")]}
            if fresh:
                return own
            self.__dict__[key] = own
        return self.__dict__[key]

    def release(self) -> None:
        """Unpersist what this workspace keeps in memory."""
        for v in list(self.__dict__.values()):
            if isinstance(v, Workspace):
                v.release()
            elif isinstance(v, DataFrame) and v.is_cached:
                v.unpersist()

    def table(self, name: str) -> DataFrame:
        return coll.table(self.spark, self.sf_dir, name)

    @cached_property
    def documents(self) -> DataFrame:
        """The document table, spread over all cores when it is small."""
        return spread_small(self.table("documents"), key="doc_id")

    @cached_property
    def corpus(self) -> DataFrame:
        return coll.corpus_from_documents(self.documents)

    @cached_property
    def prepared(self) -> DataFrame:
        return textprep.prepare_joined(self.corpus)

    @cached_property
    def topics(self) -> DataFrame:
        topics = coll.topics_from_benchmark(self.table("benchmark"))
        return (topics if self.variant is None else topics.filter(topics.variant == self.variant)).cache()

    def judged(self) -> DataFrame:
        """The judgments, derived anew."""
        return coll.qrels_from_containment(self.documents, self.table("benchmark"), self.table("labels"))

    @property
    def qrels_key(self) -> tuple:
        return self.state("documents", "benchmark", "labels")

    @cached_property
    def qrels(self) -> DataFrame:
        """The stored judgments, derived where they are missing."""
        return materialize(self.judged, "qrels", self.qrels_key, self.spark).cache()

    @property
    def run_key(self) -> tuple:
        return (*self.state("documents", "benchmark"), 100, lexical.BM25Params())

    @cached_property
    def stored_run(self) -> DataFrame:
        """The stored run of BM25 % 100."""
        return materialize(lambda: self.bm25(100), "bm25", self.run_key, self.spark)

    def counts(self) -> DataFrame:
        """``(name, n)`` of the tables; what is stored was counted while it was written, or in the terms' statistics."""
        parts = self.index_parts
        self.index, self.qrels, self.stored_run  # noqa: B018 -- built where they are missing
        def total(name, stored):
            rows = None
            for key in parts:
                one = stored_count(self.spark, stored, key)
                rows = one if rows is None else rows.unionByName(one)
            return rows.agg(F.sum("n").alias("n")).select(F.lit(name).alias("name"), "n")
        # A term's df is the number of its postings; the table of postings is not needed for that.
        posts = self.index.term_stats.agg(F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("n"))
        out = total("documents", "doc-terms").unionByName(posts.select(F.lit("postings").alias("name"), "n"))
        out = out.unionByName(stored_count(self.spark, "qrels", self.qrels_key))
        out = out.unionByName(stored_count(self.spark, "bm25", self.run_key).select(F.lit("bm25_top100").alias("name"), "n"))
        return out.unionByName(self.topics.agg(F.count(F.lit(1)).alias("n")).select(F.lit("topics").alias("name"), "n"))

    def state(self, *names: str) -> tuple:
        """What a stored table made from these tables is keyed by: their files' paths, sizes and times."""
        return (*[self.memo_value(("state", n), lambda n=n: fingerprint(self.spark, f"{self.sf_dir}/{n}.parquet")) for n in names], __version__)

    def memo_value(self, key, build):
        if key not in self.__dict__:
            self.__dict__[key] = build()
        return self.__dict__[key]

    @cached_property
    def index(self) -> lexical.Index:
        """The stored lexical index of this folder's corpus, built where it is missing; files added later extend it."""
        return lexical.merged([lexical.store_index(self._prepare(files), key) for key, files in zip(self.index_parts, self._segments, strict=True)], tuple(self.index_parts), self.spark)

    def _prepare(self, files: list[str]) -> DataFrame:
        return textprep.prepare_joined(coll.corpus_from_documents(spread_small(self.spark.read.parquet(*files), key="doc_id")))

    @cached_property
    def index_parts(self) -> list[tuple]:
        """The keys of the index's segments."""
        path = f"{self.sf_dir}/documents.parquet"
        key = (path, "joined text", __version__)
        found = segments(self.spark, "index", key, path)
        self._segments = [files for _, files in found]
        return [(*key, number) for number, _ in found]

    def _key(self, *parts) -> tuple:
        return (*self.state("documents"), "candidate text", *parts, dense.DIM)

    def forward_at_once(self) -> None:
        """Makes ``forward`` and ``forward_terms`` in one pass over the texts, as one table, where neither is stored."""
        if not any(is_bucketed(self.spark, name, self._key(kind), "docno") for name, kind in (("forward", "hashed"), ("forward-terms", "codes"))):
            bucketed(lambda: dense.vectors_and_words(textprep.candidate_texts(self.corpus), ["docno"]), "forward-both", self._key("hashed", "codes"), self.spark, "docno")

    def _forward(self, name: str, kind: str, columns: tuple, build) -> DataFrame:
        """One of the two: from the table of both if that is stored, else its own."""
        if is_bucketed(self.spark, "forward-both", self._key("hashed", "codes"), "docno"):
            return bucketed(None, "forward-both", self._key("hashed", "codes"), self.spark, "docno").select("docno", *columns)
        return bucketed(build, name, self._key(kind), self.spark, "docno")

    @cached_property
    def forward(self) -> DataFrame:
        """The stored forward index ``(docno, vec, norm)`` of the candidates' texts (P5), bucketed by docno."""
        def build():
            return dense.hashed_vectors(textprep.candidate_texts(self.corpus), ["docno"])

        return self._forward("forward", "hashed", ("vec", "norm"), build)

    @cached_property
    def forward_passages(self) -> DataFrame:
        """The same for every passage, ``(docno, psg, vec, norm)``."""
        def build():
            texts = self.documents.select(F.col("doc_id").alias("docno"), "text")
            return dense.hashed_vectors(dense.passages(texts), ["docno", "psg"])

        return bucketed(build, "forward-passages", (*self.state("documents"), "passages", "hashed", dense.DIM), self.spark, "docno")

    @cached_property
    def forward_terms(self) -> DataFrame:
        """``(docno, words, codes)``, the distinct words of the candidates' texts and their token vectors' codes."""
        def build():
            words = textprep.candidate_texts(self.corpus).select("docno", F.array_distinct(tokens("text")).alias("words"))
            return dense.with_codes(words, "words")

        return self._forward("forward-terms", "codes", ("words", "codes"), build)

    @cached_property
    def token_index(self) -> DataFrame:
        """The stored multi-vector index of ``tok_vectors``, a document a row: ``(docno, tokens)``, bucketed by docno."""
        return bucketed(lambda: multivector.token_rows(self.table("embeddings")), "token-index", (*self.state("embeddings"), "fours"), self.spark, "docno")

    def bm25(self, k: int | None = 100, params: lexical.BM25Params | None = None) -> DataFrame:
        key = ("bm25", k, params)
        if key not in self.__dict__:
            self.__dict__[key] = lexical.bm25(self.index, self.topics, k=k, params=params).cache()
        return self.__dict__[key]

    def memo(self, key, build, settle: bool = False):
        """Keep a small derived frame under ``key``: cached, or checkpointed
        to the shared folder when ``settle`` (deep plans)."""
        if key not in self.__dict__:
            self.__dict__[key] = settled(build()) if settle else build().cache()
        return self.__dict__[key]


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The session's workspace for ``sf_dir``; switching folders releases the
    previous workspace's cached frames, so memory does not accumulate."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    ws = _WORKSPACES.get(key)
    if ws is None:
        reset()
        ws = _WORKSPACES[key] = Workspace(spark, sf_dir)
    return ws


def reset() -> None:
    """Forget all workspaces (their cached frames are unpersisted)."""
    for ws in _WORKSPACES.values():
        ws.release()
    _WORKSPACES.clear()
    release()
