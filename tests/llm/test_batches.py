"""Arrow batches that operators get are bounded by bytes, not only by rows."""

import pyarrow as pa
import pytest

from factloom import scratch
from factloom.llm import jaccard_join, pieces
from factloom.llm.queries import tokenizer

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY)
    if before is not None:
        spark.conf.set(KEY, before)


def _sizes(spark):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    rows = spark.range(3000).selectExpr("id", "repeat(cast(id as string), 2500) as text").coalesce(1)
    return [(r.n, r.size) for r in rows.mapInArrow(size, "n long, size long").collect()]


@pytest.mark.parametrize("use", [lambda d: jaccard_join.sketches(d, jaccard_join.Paths()), lambda d: pieces.encode(d, tokenizer("piece_bpe_32k.model")), lambda d: pieces.round_trip(d, tokenizer("piece_bpe_32k.model"))])
def test_batches_are_bounded_by_bytes(unbounded, use):
    use(unbounded.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    sizes = _sizes(unbounded)
    assert sum(n for n, _ in sizes) == 3000 and len(sizes) > 1
    assert max(size for _, size in sizes) <= scratch.BATCH + 20_000


def test_a_bound_of_the_session_stays(unbounded):
    unbounded.conf.set(KEY, "1m")
    scratch.small_batches(unbounded)
    assert unbounded.conf.get(KEY) == "1m"
