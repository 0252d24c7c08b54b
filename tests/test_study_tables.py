"""Study files dealt to partitions by tasks."""

import os
import pickle
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rayloom.sources import listing, studies, study_source

from .test_sources import build


def test_tables_of_files_are_balanced(spark):
    rng = random.Random(1)
    files = [(f"f{i}", rng.choice([2_000, 500_000, 30_000_000])) for i in range(10_000)] + [("large", 2 << 30)]
    found = spark.createDataFrame(files, "path string, length long")

    def parts(*limits):
        folder = study_source.dealt_tables(found, *limits).removeprefix("file:")
        return [list(zip(*pq.read_table(f"{folder}/{n}").to_pydict().values())) for n in sorted(os.listdir(folder)) if n.endswith("parquet")]

    dealt = parts(F.col("length"), 256 << 20, 5000)
    assert sorted(f for p in dealt for f in p) == sorted(files)
    sums = sorted(sum(s for _, s in p) for p in dealt)
    assert sums[-1] == 2 << 30 and sums[-2] <= 1.15 * sums[0]
    assert max(map(len, parts(F.lit(1), 1 << 40, 300))) <= 300


@pytest.mark.parametrize("n", [3, 300])
def test_partitions_of_a_read_name_no_files(spark, tmp_path, n):
    for i in range(n):
        (tmp_path / f"{i}.dcm").write_bytes(build(bytes([i % 256])))
    folder = study_source.dealt_tables(listing.files(spark, [str(tmp_path)]), F.lit(1), 1 << 40, 1000)
    reader = study_source.StudySource({"tables": folder}).reader(StructType.fromDDL(studies.METADATA))
    (part,) = reader.partitions()
    assert len(pickle.dumps(part)) < 500
    assert sorted(b.column("path")[0].as_py() for b in reader.read(part)) == sorted(f"{tmp_path}/{i}.dcm" for i in range(n))
    assert study_source.read(spark, str(tmp_path)).count() == n
