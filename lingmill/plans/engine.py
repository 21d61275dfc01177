"""An engine: rules, model and thresholds put together from settings; and training runs from settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingmill.config import BuilderConfig, EngineConfig, TrainConfig
from lingmill.functions.tokenize import tokens
from lingmill.functions.urls import UrlRules
from lingmill.operators import detect as D
from lingmill.operators import russian as R
from lingmill.operators import train as T
from lingmill.session import cut_lineage
from lingmill.sources import model_files


@dataclass
class Engine:
    spark: SparkSession
    config: EngineConfig
    rules: UrlRules
    model: DataFrame
    _local: D.LocalDetector | None = field(default=None, repr=False)

    @classmethod
    def create(cls, spark: SparkSession, config: EngineConfig, model: DataFrame | None = None, lang_ids: dict[str, int] | None = None, text_files: dict[str, str] | None = None) -> Engine:
        """The model is the one given, or read as the settings say: text files by language, binary ones with the languages'
        numbers."""
        rules = UrlRules.from_xml(config.url_resources) if config.url_resources else UrlRules.default()
        if model is None:
            if config.model_format == "text":
                files = dict(config.text_files) or {k: f"{config.model_path}/{v}" for k, v in (text_files or {}).items()}
                model = model_files.read_text_model(spark, files)
            elif config.model_format == "binary":
                model = model_files.read_binary_model(spark, list(config.binary_files) or config.model_path, lang_ids or {})
            else:
                model = model_files.load_model(spark, config.model_path)
        return cls(spark, config, rules, model)

    def tokenize(self, df: DataFrame, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
        return df.withColumn(out_col, tokens(F.col(text_col), self.rules))

    def detect(self, df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
        """(id, reason, langs). The model is packed once for the engine; one too large for that is joined."""
        docs = df.select(id_col, text_col)
        try:
            local = self.local_detector()
        except D.ModelTooLarge:
            return D.detect(self.tokenize(docs, text_col), self.model, id_col, "tokens", self.config.detector)
        return local.detect(docs, tokens(F.col(text_col), self.rules)).select(id_col, "reason", "langs")

    def russian_vocabulary(self) -> DataFrame:
        """The n-grams of the Russian model file."""
        return R.russian_vocabulary(model_files.read_text_model(self.spark, {"RU": self.config.russian_file}))

    def detect_ru(self, df: DataFrame, vocabulary: DataFrame | None, id_col: str, text_col: str = "text") -> DataFrame:
        words = vocabulary if vocabulary is not None else self.russian_vocabulary()
        return R.detect_ru(self.tokenize(df.select(id_col, text_col), text_col), words, id_col, text_col, "tokens", self.config.russian)

    def local_detector(self) -> D.LocalDetector:
        if self._local is None:
            self._local = D.LocalDetector(self.model, self.config.detector)
        return self._local


def build_models(spark: SparkSession, config: BuilderConfig, rules: UrlRules | None = None) -> list[str]:
    """Trains the models of a corpus folder as the settings say and writes them as text files; their paths. Each group is a
    folder, each file a document, whose n-grams reach over the ends of lines. A document without a word is an error."""
    lines = None
    for group in config.groups:
        part = model_files.read_corpus(spark, f"{config.input_folder.rstrip('/')}/{group}", config.input_encoding).withColumn("grp", F.lit(group))
        lines = part if lines is None else lines.unionByName(part)
    if lines is None:
        return []
    docs = T.require_words(cut_lineage(lines.select("grp", "doc", "line_no", tokens(F.col("text"), rules or UrlRules.default()).alias("tokens"))))
    skip = F.col("grp").isin(list(config.groups_without_cyrillic)) if config.groups_without_cyrillic else None
    out = []
    for c in TrainConfig.all_models() if config.all_models else [config.train]:
        model = T.train(docs, c, skip, line_col="line_no")
        out += model_files.write_text_model(model, config.output_folder, c.order, c.cut, encoding=config.output_encoding)
    return out
