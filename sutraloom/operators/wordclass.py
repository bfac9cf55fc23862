"""Character-level word classes: features, invented junk, splits, a classifier, and reports on predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sutraloom.functions import text as T
from sutraloom.runtime import collect_bounded

WIDTH = 40


# Names of the classes.
NAMES = {0: "English", 1: "Sanskrit", 2: "Junk"}


def labelled_rows(words: DataFrame, word: str, label: str) -> DataFrame:
    """(word, label): rows with both, blanks stripped."""
    return words.where(F.col(word).isNotNull() & F.col(label).isNotNull()).select(T.strip(F.col(word)).alias("word"), F.col(label).alias("label"))


def class_name(label: Column) -> Column:
    """The name of a class; null for an unknown one."""
    out = F.lit(None).cast("string")
    for k, name in NAMES.items():
        out = F.when(label == k, name).otherwise(out)
    return out


def shuffled(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in a fixed random order: by a hash of columns, by range partitions rather than in one task."""
    return rows.orderBy(F.xxhash64(F.lit(42), *columns), *columns)


def character_index(words: DataFrame, word: str) -> DataFrame:
    """(ch, n, rank): characters of the lower-case words by frequency, rank 1 first, ties in code-point order.

    Characters are few; they are ranked after their counts."""
    chars = words.where(F.col(word).isNotNull() & (F.col(word) != "")).select(F.explode(F.split(F.lower(F.col(word)), "")).alias("ch"))
    counts = chars.where(F.col("ch") != "").groupBy("ch").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "ch")))
    return counts.agg(ordered.alias("a")).select(F.posexplode("a").alias("at", "x")).select(F.col("x.ch").alias("ch"), (-F.col("x.o")).alias("n"), (F.col("at") + 1).cast("bigint").alias("rank"))


def encoded(words: DataFrame, key: str, word: str, width: int = WIDTH) -> DataFrame:
    """(key, codes): each word as `width` character ranks, longer words by their last characters, zeros at the end."""
    ranks = {r["ch"]: r["rank"] for r in collect_bounded(character_index(words, word), 200_000, "characters")}
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]) if ranks else F.lit(None).cast("map<string,int>")
    last = lambda cs: F.when(F.size(cs) > width, F.slice(cs, -width, width)).otherwise(cs)
    code = lambda cs: F.transform(last(cs), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0)).cast("int"))
    padded = T.let(T.let(F.split(F.lower(F.col(word)), ""), code), lambda kept: F.concat(kept, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(width) - F.size(kept)))))
    return words.where(F.col(word).isNotNull() & (F.col(word) != "")).select(key, padded.alias("codes"))


def label_counts(words: DataFrame, label: str) -> DataFrame:
    return words.groupBy(label).agg(F.count("*").alias("n"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
# What scanning makes of letters.
SWAPS = {"a": "o", "i": "l", "s": "f", "c": "e", "n": "m", "r": "n", "u": "v", "h": "b"}


def _rand(seed: int, i: int) -> Column:
    """A random number of a seed; those of different i share no stream, which is of the seed plus the partition."""
    return F.rand(seed + i * 1_000_003)


def _letter(u: Column) -> Column:
    return F.substring(F.lit(_LETTERS), F.floor(u * 26).cast("int") + 1, F.lit(1))


def random_junk(spark: SparkSession, n: int, seed: int = 0, low: int = 3, high: int = 20, label: int = 2) -> DataFrame:
    """(ascii, label): n strings of random letters of low to high characters."""
    size = F.floor(_rand(seed, 0) * (high - low + 1)).cast("int") + low
    letters = F.array(*[_letter(_rand(seed, 1 + i)) for i in range(high)])
    return spark.range(n).select(F.array_join(F.slice(letters, 1, size), "").alias("ascii"), F.lit(label).alias("label"))


def _edited(words: DataFrame, word: str, edits: tuple[str, ...], shortest: int, seed: int, label: int) -> DataFrame:
    """(ascii, label): each word after one or two random edits; a word of `shortest` letters loses none."""
    rows = words.where(F.length(word) > 0).select(F.col(word).alias("ascii"), *[_rand(seed, i).alias(f"_{i}") for i in range(7)])
    for k in (1, 4):
        c, n = F.col("ascii"), F.length("ascii")
        at, x = F.floor(F.col(f"_{k}") * n).cast("int") + 1, _letter(F.col(f"_{k + 1}"))
        head, tail = F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, n)
        here, follows = F.substring(c, at, F.lit(1)), F.substring(c, at + 1, F.lit(1))
        made = {
            "insert": F.concat(head, x, here, tail),
            "delete": F.when(n > shortest, F.concat(head, tail)).otherwise(c),
            "swap": F.when(at < n, F.concat(head, follows, here, F.substring(c, at + 2, n))).otherwise(c),
            "replace": F.concat(head, x, tail),
        }
        which = F.floor(F.col(f"_{k + 2}") * len(edits)).cast("int") + 1
        new = F.element_at(F.array(*[made[e] for e in edits]), which)
        rows = rows.withColumn("ascii", new if k == 1 else F.when(F.col("_0") < 0.5, new).otherwise(c))
    return rows.select("ascii", F.lit(label).alias("label"))


def misspelled(words: DataFrame, word: str, seed: int = 0, label: int = 2) -> DataFrame:
    """(ascii, label): each word with one or two typing errors: a letter too many or few, exchanged or swapped."""
    return _edited(words, word, ("insert", "delete", "swap", "replace"), 3, seed, label)


def noisy(words: DataFrame, word: str, seed: int = 0, label: int = 1) -> DataFrame:
    """(ascii, label): each word with one or two letters swapped, exchanged or dropped, of the word's own class."""
    return _edited(words, word, ("swap", "replace", "delete"), 4, seed, label)


def swapped(words: DataFrame, word: str, seed: int = 0, label: int = 2) -> DataFrame:
    """(ascii, label): each word with one or two of its letters, at random places, as scanning reads them."""
    rows = words.where(F.col(word).isNotNull()).select(F.col(word).alias("ascii"), *[_rand(seed, i).alias(f"_{i}") for i in range(3)])
    for k in (1, 2):
        c, at = F.col("ascii"), F.floor(F.col(f"_{k}") * F.length("ascii")).cast("int") + 1
        new = F.concat(F.substring(c, F.lit(1), at - 1), F.translate(F.substring(c, at, F.lit(1)), "".join(SWAPS), "".join(SWAPS.values())), F.substring(c, at + 1, F.length(c)))
        rows = rows.withColumn("ascii", new if k == 1 else F.when(F.col("_0") < 0.5, new).otherwise(c))
    return rows.select("ascii", F.lit(label).alias("label"))


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) from the md5 of columns: the same for a row in any engine, order or partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_by_hash(rows: DataFrame, *columns: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """Rows with `part` (train, valid, test). Each label is split in the same shares up to chance, without a sort or a
    group of all rows of a label."""
    u = hash_share(*columns)
    return rows.withColumn("part", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


def stratified_split(rows: DataFrame, label: str, *columns: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """Rows with `part` (train, valid, test) in the same shares of each label, up to one row in 10,000. The bounds are
    quantiles of a hash by label, which tasks sketch: no label's rows are sorted or meet in one task."""
    rows = rows.withColumn("_u", hash_share(*columns))
    bounds = rows.groupBy(F.col(label).alias("_label")).agg(F.percentile_approx("_u", [train, train + valid], 10_000).alias("_cut"))
    met = rows.join(F.broadcast(bounds), F.col(label).eqNullSafe(F.col("_label")))
    part = F.when(F.col("_u") <= F.get("_cut", F.lit(0)), "train").when(F.col("_u") <= F.get("_cut", F.lit(1)), "valid").otherwise("test")
    return met.withColumn("part", part).drop("_u", "_label", "_cut")


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """(label, index from 0): the distinct labels in order; labels are few."""
    labels = F.array_sort(F.collect_set(label))
    return rows.where(F.col(label).isNotNull()).agg(labels.alias("a")).select(F.posexplode("a").alias("index", "label")).select("label", F.col("index").cast("bigint").alias("index"))


def fit_classifier(train: DataFrame, word: str, label: str, features: int = 1 << 14, seed: int = 7):
    """A pipeline of character n-grams, hashing and multinomial logistic regression; words in lower case."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    tf = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features)
    lr = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=40, regParam=1e-4, family="multinomial", probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw")
    return Pipeline(stages=[tf, lr]).fit(with_grams(train.where(F.col(word).isNotNull() & F.col(label).isNotNull()), word))


def save_classifier(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def with_grams(rows: DataFrame, word: str) -> DataFrame:
    """Rows with the distinct character 1- to 4-grams of each word between ^ and $."""
    w = F.concat(F.lit("^"), F.lower(F.col(word)), F.lit("$"))
    grams = [F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i, n=n: F.substring(w, i, F.lit(n))) for n in (1, 2, 3, 4)]
    return rows.withColumn("_grams", F.array_distinct(F.concat(*grams)))


def predict(model, rows: DataFrame, word: str) -> DataFrame:
    """Rows with `probability` (array) and `predicted`, by the rule of `decide`."""
    from pyspark.ml.functions import vector_to_array

    made = model.transform(with_grams(rows.where(F.col(word).isNotNull()), word)).withColumn("probability", vector_to_array("_probability"))
    return made.drop("_grams", "_features", "_raw", "_probability", "_prediction").withColumn("predicted", decide(F.col("probability")))


def decide(p: Column) -> Column:
    """The most probable class; where it is unsure (below 0.6) and class 1 leads class 0 by more than 0.15, class 1."""
    top = F.array_max(p)
    first = F.array_position(p, top).cast("int") - 1
    return F.when((top < 0.6) & (F.get(p, F.lit(1)) - F.get(p, F.lit(0)) > 0.15), 1).otherwise(first)


def confusion(rows: DataFrame, label: str, predicted: str, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(label, p0, p1, ...): counts by true and predicted class."""
    sums = [F.count_if(F.col(predicted) == c).alias(f"p{c}") for c in classes]
    return rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(*sums)


def class_report(rows: DataFrame, label: str, predicted: str, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(class, precision, recall, f1, support) of each class, `accuracy`, `macro` and `weighted`: one aggregation."""
    t, p = F.col(label), F.col(predicted)
    sums = [F.count("*").alias("n"), F.count_if(t == p).alias("right")]
    for c in classes:
        sums += [F.count_if((t == c) & (p == c)).alias(f"h{c}"), F.count_if(p == c).alias(f"g{c}"), F.count_if(t == c).alias(f"s{c}")]
    one = rows.where(t.isNotNull() & p.isNotNull()).agg(*sums)
    zero = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.greatest(b, F.lit(1)))
    parts = []
    for c in classes:
        pr, re = zero(F.col(f"h{c}"), F.col(f"g{c}")), zero(F.col(f"h{c}"), F.col(f"s{c}"))
        parts.append(F.struct(F.lit(str(c)).alias("class"), pr.alias("precision"), re.alias("recall"), F.when(pr + re == 0, 0.0).otherwise(2 * pr * re / F.when(pr + re == 0, 1.0).otherwise(pr + re)).alias("f1"), F.col(f"s{c}").alias("support")))
    rows_ = one.withColumn("per", F.array(*parts))
    mean = lambda f: F.aggregate("per", F.lit(0.0), lambda a, x: a + x[f]) / len(classes)
    weighted = lambda f: zero(F.aggregate("per", F.lit(0.0), lambda a, x: a + x[f] * x["support"]), F.col("n"))
    accuracy = zero(F.col("right"), F.col("n"))
    total = F.array(
        F.struct(F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro").alias("class"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f1").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted").alias("class"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"), F.col("n").alias("support")),
    )
    made = rows_.select(F.explode(F.concat("per", total)).alias("r")).select("r.*")
    return made.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def best_epoch(log: DataFrame) -> DataFrame:
    """(epoch from 1, val_loss, val_accuracy) of the epoch with the least validation loss, the first of equals."""
    best = F.min_by(F.struct("epoch", "val_loss", "val_accuracy"), F.struct("val_loss", "epoch")).alias("b")
    return log.agg(best).select((F.col("b.epoch") + 1).cast("bigint").alias("epoch"), "b.val_loss", "b.val_accuracy")
