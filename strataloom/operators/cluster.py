"""Clusters of aggregated entities and relations: batches, greedy acceptance, merging, remapping."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.fixed_values import ENTITY_BATCH, RELATION_BATCH
from ..functions.responses import top_n

#: Batches that one call into Python holds.
BATCHES = 256
#: Result rows that a task holds before it passes them on.
RESULTS = 1 << 16


def numbered(rows: DataFrame, order: Iterable[str], name: str = "idx") -> DataFrame:
    """``rows`` numbered from 1 by columns that tell them apart: ranges of the order are numbered side by side, each after the rows of those before."""
    order = list(order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")))
    before, offsets = 0, []
    for part, n in sorted(dealt.groupBy("_part").agg(F.count(F.lit(1))).collect()):  # one row a range
        offsets.append((part, before))
        before += n
    first = dealt.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return dealt.join(F.broadcast(first), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def batches(rows: DataFrame, size: int) -> DataFrame:
    """``batch``: rows in runs of ``size`` by their index ``idx``."""
    return rows.withColumn("batch", F.floor(F.col("idx") / size).cast("long"))


def entity_inputs(entities: DataFrame) -> DataFrame:
    """What a clustering model is shown of each entity."""
    return entities.select(
        F.col("idx").alias("id"), F.col("nome_entita_canonico_provvisorio").alias("nome_principale"), F.col("tipo_entita_canonico_provvisorio").alias("tipo_principale"), F.col("tutti_nomi_originali").alias("tutti_nomi"), F.col("tutti_tipi_rilevati").alias("tutti_tipi"),
        top_n(F.col("descrizioni_aggregate"), 2).alias("descrizioni"), F.col("conteggio_occorrenze").alias("occorrenze"),
    )


def relation_inputs(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("idx").alias("id"), F.col("soggetto_norm").alias("soggetto"), F.col("predicato_norm").alias("predicato"), F.col("oggetto_norm").alias("oggetto"), top_n(F.col("contesti"), 1).alias("contesti"), F.col("conteggio_occorrenze").alias("occorrenze"))


def accept_greedily(clusters: DataFrame) -> DataFrame:
    """(batch, ord, membri_ids) clusters taken in order, each only if none of its members was taken before.

    Members are ids of their own batch, so batches are independent and a batch,
    which has a bounded number of members, is one group.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for _, batch in rows.sort_values("ord").groupby("batch", dropna=False):
            taken: set[int] = set()
            for i, members in batch["membri_ids"].items():
                ids = {int(m) for m in members if m is not None and m >= 0}
                if ids and not ids & taken:
                    taken |= ids
                    kept.append(i)
        return rows.loc[kept]

    return clusters.groupBy(_held()).applyInPandas(run, clusters.schema)


def leftovers(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows by ``idx`` that no cluster holds."""
    members = clusters.select(F.explode(F.col("membri_ids").cast("array<bigint>")).alias("idx")).distinct()
    return rows.join(members, rows["idx"].cast("long") == members["idx"], "left_anti")


def _union(c: str) -> Column:
    """Sorted distinct entries of collected arrays without empty ones; equal arrays are one before they are shuffled."""
    return F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set(c))), lambda x: x.isNotNull() & (x.cast("string") != "")))


def merge_clusters(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """Clusters (cluster_id, nome_cluster, tipo_cluster, membri_ids) with their members' data; ids without a row are ignored."""
    members = clusters.select("cluster_id", F.explode(F.col("membri_ids").cast("array<bigint>")).alias("idx"))
    data = members.join(entities.withColumn("idx", F.col("idx").cast("long")), "idx").groupBy("cluster_id").agg(
        _union("tutti_nomi_originali").alias("membri_cluster"), _union("tutti_tipi_rilevati").alias("tipi_membri_cluster"), _union("descrizioni_aggregate").alias("descrizioni_aggregate"), _union("fonti_chunk_id").alias("fonti_aggregate_chunk_id"),
        F.sum("conteggio_occorrenze").alias("conteggio_occorrenze_totale"),
    )
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    return clusters.join(data, "cluster_id", "left").select(
        "cluster_id", F.coalesce("nome_cluster", F.lit("Entità_Sconosciuta")).alias("nome_entita_cluster"), F.coalesce("tipo_cluster", F.lit("TipoSconosciuto")).alias("tipo_entita_cluster"),
        empty("membri_cluster"), empty("tipi_membri_cluster"), empty("descrizioni_aggregate"), empty("fonti_aggregate_chunk_id"), F.coalesce("conteggio_occorrenze_totale", F.lit(0)).alias("conteggio_occorrenze_totale"), F.col("membri_ids").alias("membri_ids_originali"),
    )


def singletons(entities: DataFrame) -> DataFrame:
    """A cluster of its own for each entity, in the layout of ``merge_clusters`` without ``cluster_id``."""
    return entities.select(
        F.col("nome_entita_canonico_provvisorio").alias("nome_entita_cluster"), F.col("tipo_entita_canonico_provvisorio").alias("tipo_entita_cluster"), F.col("tutti_nomi_originali").alias("membri_cluster"), F.col("tutti_tipi_rilevati").alias("tipi_membri_cluster"),
        "descrizioni_aggregate", F.col("fonti_chunk_id").alias("fonti_aggregate_chunk_id"), F.col("conteggio_occorrenze").alias("conteggio_occorrenze_totale"), F.array(F.col("idx").cast("int")).alias("membri_ids_originali"),
    )


def merge_relation_clusters(clusters: DataFrame, relations: DataFrame) -> DataFrame:
    """Relation clusters (cluster_id, soggetto_cluster, predicato_cluster, oggetto_cluster, membri_ids) with their members' data; ids without a row are ignored."""
    members = clusters.select("cluster_id", F.explode(F.col("membri_ids").cast("array<bigint>")).alias("idx"))
    data = members.join(relations.withColumn("idx", F.col("idx").cast("long")), "idx").groupBy("cluster_id").agg(
        _union("contesti").alias("contesti_aggregati"), _union("fonti_chunk_id").alias("fonti_aggregate_chunk_id"), _union("fonti_sezione").alias("fonti_aggregate_sezione"),
        F.array_sort(F.filter(F.collect_set("predicato_norm"), lambda p: p != "")).alias("predicati_originali_cluster"), F.sum("conteggio_occorrenze").alias("conteggio_occorrenze_totale"),
    )
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    return clusters.join(data, "cluster_id", "left").select(
        "cluster_id", F.coalesce("soggetto_cluster", F.lit("Soggetto_Sconosciuto")).alias("soggetto_cluster"), F.coalesce("predicato_cluster", F.lit("Predicato_Sconosciuto")).alias("predicato_cluster"),
        F.coalesce("oggetto_cluster", F.lit("Oggetto_Sconosciuto")).alias("oggetto_cluster"), empty("contesti_aggregati"), empty("fonti_aggregate_chunk_id"), empty("fonti_aggregate_sezione"), empty("predicati_originali_cluster"),
        F.coalesce("conteggio_occorrenze_totale", F.lit(0)).alias("conteggio_occorrenze_totale"), F.col("membri_ids").alias("membri_ids_originali"),
    )


def relation_singletons(relations: DataFrame, names: DataFrame) -> DataFrame:
    """A cluster of its own for each relation, its ends under their canonical names, in the layout of ``merge_relation_clusters`` without ``cluster_id``."""
    return remap_relations(relations, names).select(
        "soggetto_cluster", F.col("predicato_norm").alias("predicato_cluster"), "oggetto_cluster", F.col("contesti").alias("contesti_aggregati"), F.col("fonti_chunk_id").alias("fonti_aggregate_chunk_id"), F.col("fonti_sezione").alias("fonti_aggregate_sezione"),
        F.array("predicato_norm").alias("predicati_originali_cluster"), F.col("conteggio_occorrenze").alias("conteggio_occorrenze_totale"), F.array(F.col("idx").cast("int")).alias("membri_ids_originali"),
    )


def finalize_relations(clusters: DataFrame, relations: DataFrame, names: DataFrame) -> DataFrame:
    """All relation clusters: the merged ones, and a singleton for every relation that none of them holds."""
    merged = merge_relation_clusters(clusters, relations).drop("cluster_id")
    return merged.unionByName(relation_singletons(leftovers(relations, clusters), names))


def canonical_names(clustered: DataFrame) -> DataFrame:
    """(member, canonical): each lower-cased member name with the name of the last cluster by ``ord`` that holds it."""
    members = clustered.select("ord", "nome_entita_cluster", F.explode("membri_cluster").alias("m"))
    return members.groupBy(F.lower("m").alias("member")).agg(F.max_by("nome_entita_cluster", "ord").alias("canonical"))


def remap_relations(relations: DataFrame, names: DataFrame, subject: str = "soggetto_norm", object_: str = "oggetto_norm") -> DataFrame:
    """Relations with both ends replaced by canonical names where there is one; equal results are not merged."""
    out = relations
    for column, to in ((subject, "soggetto_cluster"), (object_, "oggetto_cluster")):
        side = names.select(F.col("member").alias("_m"), F.col("canonical").alias("_c"))
        out = out.join(side, F.lower(F.col(column)) == F.col("_m"), "left").withColumn(to, F.coalesce("_c", column)).drop("_m", "_c")
    return out


def _tried(provider, frame: pd.DataFrame, tries: int, pause: float) -> pd.DataFrame | None:
    """The provider's frame, or None after ``tries`` failures; each pause is twice the one before."""
    for k in range(tries):
        try:
            return provider(frame)
        except Exception:  # noqa: BLE001 - whatever a provider raises counts as a failed try
            if k + 1 < tries and pause:
                time.sleep(pause * 2**k)
    return None


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _held() -> Column:
    """What BATCHES batches that follow each other have in common."""
    return F.floor(F.col("batch") / BATCHES).cast("long")


def _batched(frame: pd.DataFrame) -> dict:
    """The rows of each batch of a frame; those without a batch are one."""
    found = {None if pd.isna(k) else int(k): rows for k, rows in frame.groupby("batch", sort=False, dropna=False)}
    for rows in found.values():
        rows.index = pd.RangeIndex(len(rows))
    return found


def _told(frames: Iterable[pd.DataFrame | None], schema: str) -> pd.DataFrame:
    """Providers' frames as one; None is a failure and has no rows."""
    columns = {c: [] for c in _columns(schema)}
    for found in frames:
        if found is not None and len(found):
            for c, values in columns.items():
                values.extend(found[c].tolist())
    return pd.DataFrame(columns, dtype=object)


def cluster_in_batches(rows: DataFrame, provider, schema: str, size: int, tries: int = 1, pause: float = 0.0) -> DataFrame:
    """A clustering provider applied to each batch: it maps a pandas frame of a batch to clusters.

    A provider that fails on a batch gives no clusters; the batch's rows are left
    over and become singletons. BATCHES batches cross to Python at once.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _told((_tried(provider, batch, tries, pause) for batch in _batched(group).values()), schema)

    return batches(rows, size).groupBy(_held()).applyInPandas(run, schema)


def cluster_together(entities: DataFrame, relations: DataFrame, provider, schema: str, sizes: tuple[int, int] = (ENTITY_BATCH, RELATION_BATCH), tries: int = 1, pause: float = 0.0) -> DataFrame:
    """One call of a provider for each run of entities and relations with the same batch number.

    The provider maps the pandas frames of a run's entities and relations, either
    of which may be empty, to rows of ``schema``. Failures are as in
    ``cluster_in_batches``. A run has a bounded number of rows; BATCHES runs cross
    to Python at once.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = _batched(left), _batched(right)
        both = ((ours.get(k, left.iloc[:0]), theirs.get(k, right.iloc[:0])) for k in dict.fromkeys((*ours, *theirs)))
        return _told((_tried(lambda _, a=a, b=b: provider(a, b), a, tries, pause) for a, b in both), schema)

    return batches(entities, sizes[0]).groupBy(_held()).cogroup(batches(relations, sizes[1]).groupBy(_held())).applyInPandas(run, schema)


def extract_in_batches(chunks: DataFrame, provider, schema: str, provenance: Iterable[str] = (), tries: int = 3, pause: float = 0.0, size: int = 10) -> DataFrame:
    """An extraction provider over (chunk_id, text, ...) rows; it maps a pandas frame of up to ``size`` rows to result rows.

    Blank texts are skipped. A run of rows that fails ``tries`` times gives no
    results and stops nothing. ``provenance``: columns of the chunk that every
    result row gets; the provider then names the row it comes from by the frame's
    index, and its own columns are those of ``schema``. Results of several runs,
    about RESULTS rows, are passed on at once.
    """
    kept = list(provenance)
    types = dict(chunks.dtypes)
    whole = ", ".join([schema, *(f"{c} {types[c]}" for c in kept)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, empty = _columns(schema), lambda: {c: [] for c in _columns(whole)}
        told = empty()
        for frame in frames:
            given = {c: frame[c].tolist() for c in kept}
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                part.index = pd.RangeIndex(len(part))
                found = _tried(provider, part, tries, pause)
                if found is None or not len(found):
                    continue
                for c in own:
                    told[c].extend(found[c].tolist())
                rows = part.index.get_indexer(found.index).tolist() if kept else []
                for c in kept:
                    values = [*given[c][at : at + size], None]  # -1, the last, is a row that the frame has not
                    told[c].extend([values[i] for i in rows])
                if len(told[own[0]]) >= RESULTS:
                    yield pd.DataFrame(told, dtype=object)
                    told = empty()
        yield pd.DataFrame(told, dtype=object)

    return chunks.where(F.length(F.trim("text")) > 0).mapInPandas(run, whole)
