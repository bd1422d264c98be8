"""Reading tables and small built-in data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns are pruned by what is asked of it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Yield of six batches of dyestuff, five samples each.
DYESTUFF = {"A": (1545, 1440, 1440, 1520, 1580), "B": (1540, 1555, 1490, 1560, 1495), "C": (1595, 1550, 1605, 1510, 1560), "D": (1445, 1440, 1595, 1465, 1545), "E": (1595, 1630, 1515, 1635, 1625), "F": (1520, 1455, 1450, 1480, 1445)}


def dyestuff(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, float(y)) for b, ys in DYESTUFF.items() for y in ys], "Batch string, Yield double")


# Reaction times (ms) on days 0 to 9 of eighteen subjects, in the order of SUBJECTS.
SUBJECTS = (308, 309, 310, 330, 331, 332, 333, 334, 335, 337, 349, 350, 351, 352, 369, 370, 371, 372)
REACTION = (
    249.56, 258.7047, 250.8006, 321.4398, 356.8519, 414.6901, 382.2038, 290.1486, 430.5853, 466.3535, 222.7339, 205.2658, 202.9778, 204.707, 207.7161,
    215.9618, 213.6303, 217.7272, 224.2957, 237.3142, 199.0539, 194.3322, 234.32, 232.8416, 229.3074, 220.4579, 235.4208, 255.7511, 261.0125,
    247.5153, 321.5426, 300.4002, 283.8565, 285.133, 285.7973, 297.5855, 280.2396, 318.2613, 305.3495, 354.0487, 287.6079, 285.0, 301.8206, 320.1153,
    316.2773, 293.3187, 290.075, 334.8177, 293.7469, 371.5811, 234.8606, 242.8118, 272.9613, 309.7688, 317.4629, 309.9976, 454.1619, 346.8311,
    330.3003, 253.8644, 283.8424, 289.555, 276.7693, 299.8097, 297.171, 338.1665, 340.8485, 305.3211, 354.0032, 387.6167, 265.4731, 276.2012,
    243.3647, 254.6723, 279.0244, 284.1912, 305.5248, 331.5229, 335.7469, 377.299, 241.6083, 273.9472, 254.4907, 270.8021, 251.4519, 254.6362,
    245.4523, 235.311, 235.7541, 237.2466, 312.3666, 313.8058, 291.6112, 346.1222, 365.7324, 391.8385, 404.2601, 416.6923, 455.8643, 458.9167,
    236.1032, 230.3167, 238.9256, 254.922, 250.7103, 269.7744, 281.5648, 308.102, 336.2806, 351.6451, 256.2968, 243.4543, 256.2046, 255.5271,
    268.9165, 329.7247, 379.4445, 362.9184, 394.4872, 389.0527, 250.5265, 300.0576, 269.8939, 280.5891, 271.8274, 304.6336, 287.7466, 266.5955,
    321.5418, 347.5655, 221.6771, 298.1939, 326.8785, 346.8555, 348.7402, 352.8287, 354.4266, 360.4326, 375.6406, 388.5417, 271.9235, 268.4369,
    257.2424, 277.6566, 314.8222, 317.2135, 298.1353, 348.1229, 340.28, 366.5131, 225.264, 234.5235, 238.9008, 240.473, 267.5373, 344.1937, 281.1481,
    347.5855, 365.163, 372.2288, 269.8804, 272.4428, 277.8989, 281.7895, 279.1705, 284.512, 259.2658, 304.6306, 350.7807, 369.4692, 269.4117, 273.474,
    297.5968, 310.6316, 287.1726, 329.6076, 334.4818, 343.2199, 369.1417, 364.1236,
)


# New cases and herd sizes by herd and period.
CASES = (
    2, 3, 4, 0, 3, 1, 1, 0, 4, 4, 3, 0, 1, 2, 2, 0, 3, 0, 2, 0, 1, 3, 0, 0, 6, 2, 0, 0, 0, 2, 0, 0, 2, 0, 0, 0, 1, 2, 0, 0, 0, 0, 1, 0, 2, 2, 1, 0, 0,
    0, 1, 0, 2, 2, 0, 0,
)
HERD_SIZE = (
    14, 12, 9, 5, 22, 18, 21, 22, 17, 12, 9, 5, 31, 28, 22, 16, 10, 9, 9, 7, 12, 10, 8, 3, 30, 25, 24, 19, 25, 24, 23, 22, 9, 7, 5, 4, 22, 18, 16, 12,
    13, 10, 9, 8, 19, 17, 14, 8, 8, 7, 5, 4, 17, 15, 12, 10,
)


# Diameters (mm) of six samples (A to F) on each of 24 plates (a to x).
DIAMETERS = (
    27, 23, 26, 23, 23, 21, 31, 27, 28, 24, 22, 25, 26, 23, 24, 23, 22, 21, 25, 23, 22, 21, 22, 22, 24, 21, 24, 20, 21, 19, 28, 24, 27, 23, 24, 24,
    24, 21, 25, 21, 21, 17, 28, 24, 26, 23, 23, 22, 27, 24, 26, 21, 24, 19, 22, 21, 23, 19, 19, 19, 25, 22, 24, 20, 24, 22, 27, 24, 27, 22, 22, 22,
    27, 23, 25, 22, 22, 22, 23, 21, 23, 20, 21, 18, 26, 23, 24, 22, 24, 20, 28, 23, 25, 22, 21, 22, 25, 23, 23, 19, 20, 20, 27, 24, 25, 23, 23, 21,
    21, 19, 22, 18, 18, 17, 27, 24, 26, 22, 23, 22, 26, 22, 24, 22, 22, 22, 27, 24, 25, 22, 22, 21, 26, 22, 26, 21, 22, 21, 22, 20, 21, 18, 18, 18,
)


def sleepstudy(spark: SparkSession) -> DataFrame:
    rows = [(float(r), i % 10, str(SUBJECTS[i // 10])) for i, r in enumerate(REACTION)]
    return spark.createDataFrame(rows, "Reaction double, Days int, Subject string")


def penicillin(spark: SparkSession) -> DataFrame:
    rows = [(d, "abcdefghijklmnopqrstuvwx"[i // 6], "ABCDEF"[i % 6]) for i, d in enumerate(DIAMETERS)]
    return spark.createDataFrame(rows, "diameter int, plate string, sample string")


def cbpp(spark: SparkSession) -> DataFrame:
    rows = [(str(i // 4 + 1), c, n, str(i % 4 + 1)) for i, (c, n) in enumerate(zip(CASES, HERD_SIZE, strict=True))]
    return spark.createDataFrame(rows, "herd string, incidence int, size int, period string")


# Yields of six simulated batches, five samples each, without a batch effect.
DYESTUFF2 = (
    7.298, 3.846, 2.434, 9.566, 7.990, 5.220, 6.556, 0.608, 11.788, -0.892, 0.110, 10.386, 13.434, 5.510, 8.166, 2.212, 4.852, 7.092, 9.288, 4.980,
    0.282, 9.014, 4.458, 8.756, 7.600, 3.070, 11.966, 4.034, 5.734, 9.442,
)

# Strength of a paste, three tests of two casks (a, b) of each of ten batches (A to J).
STRENGTH = (
    62.8, 62.6, 60.1, 62.3, 62.7, 63.1, 60.0, 61.4, 57.5, 56.9, 61.1, 58.9, 62.9, 63.6, 65.4, 66.5, 63.7, 64.0, 60.6, 60.5, 59.2, 59.0, 59.8, 60.3,
    59.2, 59.0, 60.5, 60.0, 60.1, 59.7, 59.4, 59.8, 61.5, 61.9, 60.3, 59.5, 62.4, 62.8, 64.8, 64.0, 63.0, 62.7, 58.7, 58.1, 59.2, 59.1, 58.5, 59.3,
    60.4, 60.9, 62.4, 62.6, 60.8, 60.6, 59.4, 60.2, 59.6, 59.4, 58.8, 58.1,
)


def dyestuff2(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ABCDEF"[i // 5], y) for i, y in enumerate(DYESTUFF2)], "Batch string, Yield double")


def pastes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(y, "ABCDEFGHIJ"[i // 6], "ABCDEFGHIJ"[i // 6] + ":" + "ab"[i // 3 % 2]) for i, y in enumerate(STRENGTH)], "strength double, batch string, cask string")


# Generated sets: the columns, levels and sizes of well-known studies with values drawn by a rule (hashes of the row), so that
# they are the same everywhere and at any size.

def _uniform(salt: int) -> Column:
    return (F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _level(name: str, column: Column, salt: int, spread: float) -> Column:
    """An effect of a level, uniform over plus and minus ``spread``."""
    return spread * 2 * ((F.pmod(F.xxhash64(column, F.lit(name), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40) - 0.5)


def ratings(spark: SparkSession, rows: int = 73_421) -> DataFrame:
    """Ratings y (1 to 5) of lecturers d by students s, crossed, with studage, lectage, service and dept."""
    df = spark.range(rows).withColumnRenamed("id", "i")
    df = df.select("i", (F.floor(_uniform(1) * 2972) + 1).cast("string").alias("s"), (F.floor(_uniform(2) * 1128) + 1).cast("string").alias("d"), (2 * F.floor(_uniform(3) * 4) + 2).cast("int").alias("studage"), (F.floor(_uniform(4) * 6) + 1).cast("int").alias("lectage"), F.floor(_uniform(5) * 2).cast("string").alias("service"), (F.floor(_uniform(6) * 14) + 1).cast("string").alias("dept"))
    score = 3.2 + _level("s", F.col("s"), 7, 0.6) + _level("d", F.col("d"), 8, 0.9) - 0.07 * F.col("service").cast("int") + 2.4 * (_uniform(9) - 0.5)
    return df.withColumn("y", F.least(F.lit(5), F.greatest(F.lit(1), F.round(score).cast("int")))).drop("i")


def fruits(spark: SparkSession, rows: int = 625) -> DataFrame:
    """Counts of fruits of plants: reg, popu in reg, gen in popu, rack, nutrient (1 or 8), amd (clipped or not), status."""
    df = spark.range(rows).withColumnRenamed("id", "i")
    df = df.select("i", F.element_at(F.array(*[F.lit(x) for x in ("NL", "SP", "SW")]), (F.col("i") % 3 + 1).cast("int")).alias("reg"), (F.col("i") % 9 + 1).cast("string").alias("popu"), (F.col("i") % 27 + 1).cast("string").alias("gen"), (F.col("i") % 2 + 1).cast("string").alias("rack"), F.when(_uniform(1) < 0.5, 1).otherwise(8).alias("nutrient"), F.when(_uniform(2) < 0.5, "clipped").otherwise("unclipped").alias("amd"), F.when(_uniform(3) < 0.4, "Normal").when(_uniform(3) < 0.7, "Petri.Plate").otherwise("Transplant").alias("status"))
    mean = F.exp(2.2 + 0.12 * F.col("nutrient") - 0.3 * (F.col("amd") == "clipped").cast("int") + _level("gen", F.col("gen"), 4, 0.8))
    return df.withColumn("total_fruits", F.floor(-F.log(_uniform(5)) * mean).cast("int")).drop("i")


def ticks(spark: SparkSession, rows: int = 403) -> DataFrame:
    """Ticks on chicks: INDEX, BROOD in LOCATION, HEIGHT, YEAR (95 to 97) and the count TICKS."""
    df = spark.range(rows).withColumnRenamed("id", "i")
    df = df.select("i", (F.col("i") + 1).cast("string").alias("INDEX"), (F.col("i") % 118 + 501).cast("string").alias("BROOD"), (F.col("i") % 118 % 63 + 1).cast("string").alias("LOCATION"))
    df = df.withColumn("YEAR", (95 + F.pmod(F.xxhash64("BROOD"), F.lit(3))).cast("string")).withColumn("HEIGHT", 403 + F.pmod(F.xxhash64("LOCATION"), F.lit(131)).cast("double"))
    mean = F.exp(1.2 - 0.02 * (F.col("HEIGHT") - 462) + 1.1 * (F.col("YEAR") == "96").cast("int") + _level("b", F.col("BROOD"), 3, 1.2))
    return df.withColumn("TICKS", F.floor(-F.log(_uniform(4)) * mean).cast("int")).drop("i")


def aggression(spark: SparkSession, people: int = 316) -> DataFrame:
    """Answers of people to 24 items: id, item, Anger, Gender, btype, situ, mode, resp (no, perhaps, yes) and r2 (N, Y)."""
    df = spark.range(people * 24).withColumnRenamed("id", "i")
    number, item = F.floor(F.col("i") / 24), F.col("i") % 24
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at + 1).cast("int"))
    df = df.select("i", (number + 1).cast("string").alias("id"), F.concat(F.lit("item"), item + 1).alias("item"), (11 + F.pmod(F.xxhash64(number, F.lit("anger")), F.lit(29))).cast("int").alias("Anger"), F.when(F.pmod(F.xxhash64(number), F.lit(4)) == 0, "M").otherwise("F").alias("Gender"), pick(("curse", "scold", "shout"), item % 3).alias("btype"), pick(("other", "self"), F.floor(item / 12)).alias("situ"), pick(("want", "do"), F.floor(item / 6) % 2).alias("mode"))
    score = -1.2 + 0.06 * F.col("Anger") + 1.0 * (F.col("btype") == "curse").cast("int") - 1.0 * (F.col("situ") == "self").cast("int") + _level("id", F.col("id"), 2, 1.5) + F.log(_uniform(3) / (1 - _uniform(3)))
    return df.withColumn("resp", F.when(score < 0, "no").when(score < 1.2, "perhaps").otherwise("yes")).withColumn("r2", F.when(F.col("resp") == "no", "N").otherwise("Y")).drop("i")
