"""JOIN-23. Near-duplicate keepers as images arrive: each batch is held against the keepers so far, which are kept as a table of their bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactsheet.operators.joins import band_rows, hamming_keepers, kept

def assign(spark: SparkSession, folder: str, images: DataFrame, number: int, most: int = 8) -> None:
    """Adds batch number of images (id, bits, culled) to folder, whose ids are greater than those of earlier batches.

    An image within most bits of an earlier keeper has the first such keeper; of the others of the batch keepers are chosen by id. Culled
    images are no keepers and have none. A batch that runs again replaces what it wrote, and looks at earlier batches alone.
    """
    images = kept(images.select("id", "bits", F.coalesce("culled", F.lit(False)).alias("culled")))
    live = images.where("NOT culled").select("id", "bits")
    stored = earlier(spark, f"{folder}/bands", "band int, part long, b long, y array<long>", number)
    asked = live.select(F.col("id").alias("a"), F.col("bits").alias("x"), F.inline(band_rows("bits", most, True)))
    far = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in (0, 1)), F.lit(0))
    hit = asked.join(stored, ["band", "part"]).where(far <= most).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("keeper"))
    hit = kept(hit)
    rest = hamming_keepers(live.join(hit, "id", "left_anti"), "id", "bits", most)
    found = kept(hit.unionByName(rest))
    images.select("id").join(found, "id", "left").write.mode("overwrite").parquet(f"{folder}/assigned/batch={number}")
    keepers = live.join(found.where("id = keeper").select("id"), "id", "left_semi")
    bands = keepers.select(F.inline(band_rows("bits", most, False)), F.col("id").alias("b"), F.col("bits").alias("y"))
    bands.write.mode("overwrite").parquet(f"{folder}/bands/batch={number}")

def earlier(spark: SparkSession, folder: str, schema: str, number: int) -> DataFrame:
    """What batches before number have written; no rows where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").parquet(folder).where(F.col("batch") < number).drop("batch")

def stream(images: DataFrame, folder: str, checkpoint: str, most: int = 8):
    """Runs a stream of images over all that is there and ends; results are below folder/assigned."""
    put = lambda batch, number: assign(batch.sparkSession, folder, batch, number, most)
    return images.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

def assigned(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("id long, keeper long, batch long").parquet(f"{folder}/assigned").select("id", "keeper")
