"""Text as numbers for a model: measures of a readme, and its terms as a sparse vector with learnt weights."""

from __future__ import annotations

import math
import os

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limelight.functions.hashing import key_hash
from limelight.functions.text import emoji_count, first_heading, heading_text, headings, is_title_case, tokens, word_count

MEASURES = ["headings", "words", "emojis", "title_case"]
SIZE = 256


class TextMeasures(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `headings`, `words`, `emojis` (counts) and `title_case` (1 if the first heading is in title case); null text: 0."""

    def __init__(self, column: str | None = None):
        super().__init__()
        if column is not None:
            self._set(inputCol=column)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = F.col(self.getInputCol())
        title = heading_text(first_heading(text))
        measures = [
            F.size(headings(text)).cast("bigint"), word_count(text), emoji_count(text),
            F.when((title != "") & is_title_case(title), 1).otherwise(0),
        ]
        empty = text.isNull()
        return dataset.withColumns({n: F.when(empty, 0).otherwise(m) for n, m in zip(MEASURES, measures)})


class _Hashed(HasInputCol, HasOutputCol):
    size = Param(Params._dummy(), "size", "number of buckets", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the hash", TypeConverters.toInt)

    def buckets(self) -> Column:
        """Bucket of each token, in order; none for a null text."""
        seed, size = self.getOrDefault(self.seed), self.getOrDefault(self.size)
        found = F.transform(tokens(F.col(self.getInputCol())), lambda t: key_hash(t, seed, "term") % size)
        return F.coalesce(found, F.array().cast("array<bigint>"))


class HashedTerms(Estimator, _Hashed, DefaultParamsReadable, DefaultParamsWritable):
    """Learns in how many texts each bucket of terms occurs."""

    def __init__(self, column: str | None = None, out: str = "terms", size: int = SIZE, seed: int = 1):
        super().__init__()
        self._set(outputCol=out, size=size, seed=seed)
        if column is not None:
            self._set(inputCol=column)

    def _fit(self, dataset: DataFrame) -> HashedTermsModel:
        found = dataset.select(F.explode(F.array_distinct(self.buckets())).alias("bucket"))
        counts = {r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # `size` rows
        size = self.getOrDefault(self.size)
        model = HashedTermsModel([counts.get(b, 0) for b in range(size)], dataset.count())
        return self._copyValues(model)


class HashedTermsModel(Model, _Hashed, MLReadable, MLWritable):
    """Adds a sparse vector of count * ln((texts + 1) / (texts with the bucket + 1)) per bucket.

    The state is `size` numbers and is saved as a table of its own beside the parameters.
    """

    def __init__(self, document_frequency: list[int] | None = None, documents: int = 0):
        super().__init__()
        self.document_frequency, self.documents = document_frequency or [], documents

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, counts = f"{self.uid}_names", f"{self.uid}_counts"
        out, size = self.getOutputCol(), self.getOrDefault(self.size)
        # The vocabulary of the counter is the list of bucket numbers, so it makes the sparse vector in the JVM.
        counter = CountVectorizerModel.from_vocabulary([str(b) for b in range(size)], inputCol=names, outputCol=counts)
        weights = [math.log((self.documents + 1) / (n + 1)) for n in self.document_frequency]
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=counts, outputCol=out)
        named = dataset.withColumn(names, F.transform(self.buckets(), lambda b: b.cast("string")))
        return weigh.transform(counter.transform(named)).drop(names, counts)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: HashedTermsModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        rows = [(b, n, self.instance.documents) for b, n in enumerate(self.instance.document_frequency)]
        frame = spark.createDataFrame(rows, "bucket int, document_frequency bigint, documents bigint")
        frame.coalesce(1).write.parquet(os.path.join(path, "data"))


class _Reader(MLReader):
    def load(self, path: str) -> HashedTermsModel:
        spark = self.sparkSession
        rows = spark.read.parquet(os.path.join(path, "data")).orderBy("bucket").collect()
        model = HashedTermsModel([r["document_frequency"] for r in rows], rows[0]["documents"] if rows else 0)
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
