"""Duplicate queries over more than 1,000 images, where ids of copies meant for small tables meet other images."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from specblock.operators.apps import band_masks
from specblock.plans import analytics, corpora, registry
from tests.oracle import connect, rows_of, sql_rows

IMAGES = 1001


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """A folder whose embeddings make 1,001 images of 5 x 5 blocks, and a rest of 5 vectors."""
    folder = tmp_path_factory.mktemp("many")
    n = 25 * IMAGES + 5
    values = np.random.default_rng(3).normal(size=(n, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(values)}), folder / "embeddings.parquet")
    return str(folder)


def twin(name):
    """The SQL twin with ids of copies that no image of the table has; as it stands it fails on such a table."""
    sql = registry.ORACLE_SQL[name]
    assert sql.count("image_id + 1000") == sql.count("image_id + 2000") == 1
    return sql.replace("image_id + 2000", "image_id + 4000").replace("image_id + 1000", "image_id + 2000")


def test_copies_have_their_own_ids(spark, many):
    frames = analytics.with_copies(corpora.g5(spark, many))
    ids = sorted(r.image_id for r in frames.images.select("image_id").collect())
    assert ids == [by + i for by in (0, 2000, 4000) for i in range(IMAGES)]
    assert frames.blocks.groupBy("image_id").count().where("count <> 25").isEmpty()


def test_groups_of_many_images(spark, many):
    columns, rows = rows_of(registry.QUERIES["duplicate_groups_g5"](spark, many))
    assert rows == sql_rows(connect(many), twin("duplicate_groups_g5"), columns)
    assert sum(len(r[columns.index("paths")].split(",")) for r in rows) == 3 * IMAGES


def test_duplicates_among_many_images(spark, many):
    columns, rows = rows_of(registry.QUERIES["find_duplicates_g5"](spark, many))
    assert rows == sql_rows(connect(many), twin("find_duplicates_g5"), columns)
    assert len(rows) == 3 * IMAGES


def test_bands_hold_different_blocks():
    """A block of a 5 x 5 image is sampled up to four times: samples of one block in one band would not tell images apart."""
    at = [int(i * 4 / 7) for i in range(8)]
    for mask in band_masks(5):
        blocks = [(at[slot // 8], at[slot % 8]) for slot in range(64) if mask >> (63 - slot) & 1]
        assert len(set(blocks)) == len(blocks) >= 10
