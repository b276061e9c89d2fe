"""A3: packed 2-bit genotype files as a Spark data source: one input partition per range of variants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The format's first bytes: its mark and the order by variant. Fixed values.
MAGIC = bytes([0x6C, 0x1B, 0x01])
#: Dosage of the first allele by 2-bit code. Fixed values; -1 is missing.
CODES = np.array([2, -1, 1, 0], np.int8)


class Variants(InputPartition):
    def __init__(self, indexes: list[int]):
        self.indexes = indexes


def decode(data: bytes, samples: int, second: bool = False) -> np.ndarray:
    """Dosages of one variant's bytes, four samples a byte, low bits first; second: of the second allele."""
    b = np.frombuffer(data, np.uint8)
    d = CODES[np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], 1).ravel()[:samples]]
    return np.where(d < 0, d, 2 - d).astype(np.int8) if second else d


class BedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.samples = int(options["samples"])
        self.total = int(options["variants"])
        self.second = str(options.get("allele", "1")) == "2"
        chosen = options.get("indexes", "")
        self.indexes = [int(x) for x in chosen.split(",")] if chosen else list(range(self.total))
        self.per = int(options.get("variantsPerPartition", "4096"))

    def partitions(self):
        return [Variants(self.indexes[s : s + self.per]) for s in range(0, len(self.indexes), self.per)]

    def read(self, partition):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        width = -(-self.samples // 4)
        with store.open_input_file(path) as f:
            if f.read_at(3, 0) != MAGIC:
                raise ValueError(f"{self.path} is no packed genotype file by variant")
            for s in range(0, len(partition.indexes), 256):
                part = partition.indexes[s : s + 256]
                rows = [decode(f.read_at(width, 3 + v * width), self.samples, self.second) for v in part]
                lists = pa.array([pa.array(np.where(r < 0, 0, r), pa.int8(), mask=r < 0) for r in rows], pa.list_(pa.int8()))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), lists], ["vidx", "dosages"])


class BedSource(DataSource):
    @classmethod
    def name(cls):
        return "packed_genotypes"

    def schema(self):
        return "vidx long, dosages array<tinyint>"

    def reader(self, schema):
        return BedReader(self.options)


def read_bed(spark: SparkSession, path: str, samples: int, variants: int, indexes: list[int] | None = None, allele: int = 1) -> DataFrame:
    """(vidx, dosages) of a packed file at a URI; missing is null. allele 1 counts the first allele, 2 the second. Only the bytes
    of the variants asked for are read."""
    spark.dataSource.register(BedSource)
    r = spark.read.format("packed_genotypes").option("samples", samples).option("variants", variants).option("allele", allele)
    if indexes is not None:
        r = r.option("indexes", ",".join(map(str, indexes)))
    return r.load(path)
