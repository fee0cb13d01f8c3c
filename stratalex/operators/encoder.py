"""Encoders as stages of a Spark ML pipeline: fitted on a corpus, saved, read again, applied to any text column."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.functions.text import cache_key
from stratalex.sources.stored import stored

from . import sparse as sp


class _TextParams(HasInputCol, HasOutputCol):
    keyCol = Param(Params._dummy(), "keyCol", "column that tells rows apart", TypeConverters.toString)
    dropStopwords = Param(Params._dummy(), "dropStopwords", "leave stop words out", TypeConverters.toBoolean)

    def _counts(self, rows: DataFrame) -> DataFrame:
        return sp.text_counts(rows, self.getOrDefault("keyCol"), self.getInputCol(), self.getOrDefault("dropStopwords"))

    def _take(self, given: dict) -> None:
        self._setDefault(keyCol="unit_id", inputCol="text", outputCol="weights", dropStopwords=False)
        self._set(**{k: v for k, v in given.items() if v is not None})


class SparseEncoder(Estimator, _TextParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the vocabulary of a text column: ids in code-point order from 1, and idf over all rows, empty ones included."""

    def __init__(self, keyCol: str | None = None, inputCol: str | None = None, outputCol: str | None = None, dropStopwords: bool | None = None):
        super().__init__()
        self._take({"keyCol": keyCol, "inputCol": inputCol, "outputCol": outputCol, "dropStopwords": dropStopwords})

    def _fit(self, dataset: DataFrame) -> SparseEncoderModel:
        vocab = sp.numbered(sp.vocabulary(self._counts(dataset), dataset.count()))
        model = SparseEncoderModel(stored(vocab.select("token", "token_id", "df", "idf"), "encoder"))
        return self._copyValues(model)


class SparseEncoderModel(Model, _TextParams, MLReadable, MLWritable):
    """Adds ``outputCol``: indices (ascending) and values (tf x idf) of each row; tokens outside the vocabulary weigh nothing.

    Rows keep their place in no order; a row without known tokens has empty lists. ``keyCol`` tells rows apart.
    """

    def __init__(self, vocabulary: DataFrame | None = None):
        super().__init__()
        self.vocabulary = vocabulary
        self._take({})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, out = self.getOrDefault("keyCol"), self.getOutputCol()
        postings = self._counts(dataset).join(self.vocabulary, "token").select("unit_id", "token_id", (F.col("tf") * F.col("idf")).alias("weight"))
        wire = sp.wire(postings).select(F.col("unit_id").alias("_unit"), F.struct("indices", "values").alias("_wire"))
        none = F.struct(F.array().cast("array<bigint>").alias("indices"), F.array().cast("array<double>").alias("values"))
        return dataset.join(wire, F.col(key) == F.col("_unit"), "left").withColumn(out, F.coalesce("_wire", none)).drop("_unit", "_wire")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: SparseEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.vocabulary.write.parquet(f"{path}/vocabulary")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SparseEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/vocabulary"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class EmbeddingLookup(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector that a provider has given for a text: looked up by the key of model and text in a table of vectors.

    The table (cache_key, embedding) is at ``path``. A text without a vector has null; a vector of another length than
    ``size`` is an error, as it belongs to another model.
    """

    modelName = Param(Params._dummy(), "modelName", "name in the key", TypeConverters.toString)
    path = Param(Params._dummy(), "path", "table of vectors", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "numbers in a vector", TypeConverters.toInt)

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, modelName: str | None = None, path: str | None = None, size: int | None = None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="embedding")
        given = {"inputCol": inputCol, "outputCol": outputCol, "modelName": modelName, "path": path, "size": size}
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, name = self.getOrDefault("size"), self.getOrDefault("modelName")
        table = dataset.sparkSession.read.parquet(self.getOrDefault("path")).dropDuplicates(["cache_key"])
        wrong = F.raise_error(F.concat(F.lit(f"a vector of {name} has not {size} numbers: "), F.size("embedding").cast("string")))
        checked = F.when(F.col("embedding").isNull() | (F.size("embedding") == size), F.col("embedding")).otherwise(wrong)
        vectors = table.select(F.col("cache_key").alias("_key"), checked.alias("_vector"))
        keyed = dataset.withColumn("_text_key", cache_key(F.lit(name), F.col(self.getInputCol())))
        return keyed.join(vectors, F.col("_text_key") == F.col("_key"), "left").withColumn(self.getOutputCol(), F.col("_vector")).drop("_text_key", "_key", "_vector")
