"""Rounds of vectors, and learners that read their input from disk once dealt."""

import pytest
from pyspark.sql import functions as F

from shopweave.operators import clusters as C
from shopweave.operators import messages
from shopweave.operators import models as M
from shopweave.operators import vectors as V
from shopweave.session import stored
from tests.test_graph_fixtures import edges
from tests.test_models import features
from tests.test_vertex_programs import dijkstra, random_edges


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_vector_paths_over_several_parts_and_chunks(spark, block_bytes):
    rows = random_edges(40, 3) + [(k, k + 1, 0.11) for k in range(39)] + [(99, v, 0.5) for v in range(40)]
    e = stored(edges(spark, rows).withColumnRenamed("weight", "w"), "edges")
    vertices = stored(spark.createDataFrame([(v, 0.0) for v in [*range(40), 99, 500]], "id long, info double"), "ends")
    graph = V.VectorGraph(e, vertices, 9, block_bytes=block_bytes)
    chunks = graph.chunked(spark.createDataFrame([(s,) for s in (0, 7, 8, 9, 11, 30, 39, 99, 500)], "source long"))
    assert chunks.count > 1 and (graph.parts > 1) == (block_bytes == 100)
    got = {(r.source, r.id): r.dist for r in V.vector_paths(chunks).collect()}
    assert got == pytest.approx({(s, v): d for s in (0, 7, 8, 9, 11, 30, 39, 99) for v, d in dijkstra(rows, s).items()} | {(500, 500): 0.0})


def test_many_sources_send_no_row_per_message(spark, monkeypatch):
    """The step that F7, F11 and F12 share; it used to shuffle a row for each message."""
    monkeypatch.setattr(messages.PlacedEdges, "triplets", None)
    e = edges(spark, random_edges(20, 3, 5))
    src = spark.range(0, 20, 3).select(F.col("id").alias("source"))
    members = spark.range(20).select("id", F.lit(1).alias("cluster"))
    assert C.path_summary(e, src, members).count() == 7


def test_learners_read_rows_that_are_dealt_once(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    seen, fit = [], RandomForestClassifier.fit

    def watched(self, rows):
        seen.append(rows)
        assert rows.storageLevel.useDisk
        return fit(self, rows)

    monkeypatch.setattr(RandomForestClassifier, "fit", watched)
    M.classifier_predictions(features(spark, 200).drop("after_buy_count"))
    assert not seen[0].storageLevel.useDisk  # and given back
