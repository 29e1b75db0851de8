"""Vector search over event terms, and embedding of the terms that lack a vector."""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark import fixed_values as V
from oddspark.functions.vectors import dot, norm
from oddspark.operators.nearest import CENTRES, Cells, nearest, nearest_in_cells, write_cells
from oddspark.schemas import EMBEDDINGS, QUERY_VECTORS
from oddspark.sources.tables import read_if_exists, upsert_table
from oddspark.sources.versions import Store
from oddspark.workspace import local_table, materialize

Encoder = Callable[[list[str], str], list[list[float]]]

# Query vectors that travel to every task as one value; more are dealt out in blocks.
PACKED_QUERIES = 256


def hashing_encoder(texts: list[str], kind: str = "document", dim: int = V.EMBEDDING_DIM):
    """Unit vectors from hashed character trigrams.

    A deterministic stand-in for a hosted model, for use without network: related spellings get
    related vectors. ``kind`` is accepted as hosted models distinguish documents and queries.
    """
    vectors = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        padded = f"  {text.lower()} "
        for i in range(len(padded) - 2):
            code = zlib.crc32(padded[i : i + 3].encode("utf-8"))
            vectors[row, code % dim] += 1.0 if code & 0x80000000 else -1.0
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(lengths == 0, 1.0, lengths)).tolist()


def embed_terms(
    terms: DataFrame,
    encoder: Encoder = hashing_encoder,
    kind: str = "document",
    batch: int = V.ENCODER_BATCH,
) -> DataFrame:
    """Vectors of the terms: ``pt, embedding``. The encoder sees at most ``batch`` texts a call."""
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                texts = frame["pt"].iloc[start : start + batch].tolist()
                yield pd.DataFrame({"pt": texts, "embedding": encoder(texts, kind)})

    return terms.select("pt").mapInPandas(encode, EMBEDDINGS)


def missing_terms(reactions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Distinct event terms without a vector."""
    terms = reactions.select("pt").filter(F.col("pt").isNotNull()).distinct()
    return terms.join(embeddings.select("pt"), "pt", "left_anti")


def embed_missing(
    reactions: DataFrame, embeddings: DataFrame, encoder: Encoder = hashing_encoder
) -> DataFrame:
    """Vectors of the terms that lack one, to be upserted by ``pt``.

    The terms are dealt out by name: small shuffles would otherwise be joined before the encoder,
    which is the costly step.
    """
    parts = int(reactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return embed_terms(missing_terms(reactions, embeddings).repartition(parts, "pt"), encoder)


def refresh_embeddings(
    reactions: DataFrame, path: str, out_path: str, encoder: Encoder = hashing_encoder
) -> None:
    """Embed the terms without a vector and write the merged table to ``out_path``.

    The new vectors are written down before the merge, so that no term is encoded twice.
    """
    existing = read_if_exists(reactions.sparkSession, path, EMBEDDINGS)
    new = materialize(embed_missing(reactions, existing, encoder), "embeddings")
    upsert_table(new, path, out_path, ["pt"])


def refresh_stored_embeddings(
    reactions: DataFrame, store: Store, table: str = "embeddings", encoder: Encoder = hashing_encoder
) -> bool:
    """The same in place: vectors of the missing terms are added as a new version. True if there were any.

    Stored vectors are not written again. A failed or repeated run leaves readers what they had.
    """
    new = embed_missing(reactions, store.read(table, EMBEDDINGS), encoder)
    return store.insert_ignore(table, new, ["pt"])


def query_vectors(
    spark: SparkSession, texts: list[str], encoder: Encoder = hashing_encoder
) -> DataFrame:
    """Vectors of the user's search texts: ``query, vector``."""
    vectors = encoder(texts, "query")
    rows = [{"query": t, "vector": v} for t, v in zip(texts, vectors, strict=True)]
    return local_table(spark, rows, QUERY_VECTORS)


def similarities(corpus: DataFrame, queries: DataFrame, packed: int = PACKED_QUERIES) -> DataFrame:
    """Cosine of every query with every term: ``query, pt, similarity``.

    The number of queries is looked up first. Few queries travel as one packed value next to the
    corpus, which is read in place and not shuffled. Many queries are packed into blocks; the
    corpus is dealt into one share per shuffle partition and meets every block in every share.
    A column ``query_id``, if there is one, tells vectors of the same text apart and is kept.
    """
    own = [c for c in ("query_id", "query") if c in queries.columns]
    exact = queries.withColumn("vector", F.col("vector").cast("array<double>"))
    normed = exact.withColumn("_norm", norm(F.col("vector")))
    pack = F.collect_list(F.struct(*own, "vector", "_norm")).alias("_queries")
    wide = corpus.select("pt", F.col("embedding").cast("array<double>").alias("embedding"))
    terms = wide.withColumn("_norm", norm(F.col("embedding")))
    n_queries = queries.count()
    if n_queries <= packed:
        paired = terms.withColumn("_queries", normed.agg(pack).scalar())
    else:
        n_blocks = -(-n_queries // packed)
        n_shares = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = (
            normed.withColumn("_block", F.pmod(F.xxhash64(*own), F.lit(n_blocks)).cast("int"))
            .groupBy("_block")
            .agg(pack)
            .withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(n_shares - 1))))
        )
        shares = terms.withColumn(
            "_share", F.pmod(F.xxhash64("pt"), F.lit(n_shares)).cast("int")
        ).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        paired = shares.join(blocks, ["_block", "_share"])
    scored = F.transform(
        "_queries",
        lambda q: F.struct(
            *[q[c].alias(c) for c in own],
            F.try_divide(
                dot(F.col("embedding"), q["vector"]), F.col("_norm") * q["_norm"]
            ).alias("similarity"),
        ),
    )
    return paired.select("pt", F.explode(scored).alias("hit")).select(
        *[f"hit.{c}" for c in own], "pt", "hit.similarity"
    )


def semantic_event_search(
    corpus: DataFrame, queries: DataFrame, top_k: int = 15, min_similarity: float = 0.35
) -> DataFrame:
    """The terms closest to each query: ``query, pt, similarity, rank``.

    The similarity bound applies after the top k are taken, so fewer may remain. Every row of
    ``queries`` has a ranking of its own, also if texts are equal; a ``query_id`` is returned too.
    Blocks of queries meet blocks of terms where these lie; at most k rows of a query leave a task.
    """
    if not 1 <= top_k <= 30:
        raise ValueError("top_k is 1 to 30")
    named = "query_id" in queries.columns
    asked, own = _asked(queries)
    found = nearest(corpus.select(F.col("pt").alias("id"), "embedding"), asked, top_k)
    best = _answered(found, own).filter(F.col("similarity") >= min_similarity)
    return best if named else best.drop("query_id")


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``query_id, vector`` with an id that holds the query's own columns, and a frame of those columns' types."""
    if "query_id" not in queries.columns:
        queries = queries.withColumn("query_id", F.monotonically_increasing_id())
    own = queries.select("query_id", "query")
    return queries.select(F.to_json(F.struct("query_id", "query")).alias("query_id"), "vector"), own


def _answered(found: DataFrame, own: DataFrame) -> DataFrame:
    """``query_id, query, pt, similarity, rank`` from the ids of ``_asked``."""
    return found.withColumn("own", F.from_json("query_id", own.schema)).select(
        "own.query_id", "own.query", F.col("id").alias("pt"), "similarity", "rank")


def write_search_cells(corpus: DataFrame, store: Store, width: int = V.EMBEDDING_DIM, sample: int = CENTRES) -> Cells:
    """Store the terms by cells, for searches that leave most of them unread."""
    return write_cells(corpus.select(F.col("pt").alias("id"), "embedding"), store, width, sample)


def search_in_cells(
    cells: Cells, queries: DataFrame, top_k: int = 15, min_similarity: float = 0.35
) -> tuple[DataFrame, DataFrame]:
    """``semantic_event_search`` over stored cells with the same rows, and the share of the terms read per query."""
    asked, own = _asked(queries)
    best, read = nearest_in_cells(cells, asked, top_k)
    whole = sum(n for n, _ in cells.sizes.values())
    shares = read.withColumn("own", F.from_json("query_id", own.schema)).select(
        "own.query_id", "own.query", (F.col("n_read") / whole).alias("share_read"))
    return _answered(best, own).filter(F.col("similarity") >= min_similarity), shares
