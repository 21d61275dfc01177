"""Settings, validated when made; each can be read from a key/value mapping."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace


def _percent(name: str, value: float) -> None:
    if not 0 <= value <= 100:
        raise ValueError(f"{name} must be from 0 to 100")


def _bool(value: str) -> bool:
    return str(value).strip().lower() in ("true", "1", "yes")


def from_mapping(cls, values: Mapping[str, str], names: Mapping[str, str]):
    """A settings object from a mapping; `names`: field to key. Missing keys keep the default; a value that can't be
    read is an error that names its key."""
    got = {}
    kinds = {f.name: f.type for f in fields(cls)}
    for f, key in names.items():
        if key in values:
            try:
                kind = str(kinds[f])
                got[f] = _bool(values[key]) if kind == "bool" else int(values[key]) if kind == "int" else float(values[key]) if kind == "float" else str(values[key])
            except ValueError as e:
                raise ValueError(f"{key}: {values[key]!r} is no {kinds[f]}") from e
    return cls(**got)


@dataclass(frozen=True)
class DetectorConfig:
    """Thresholds of the detector."""

    min_percent: int = 10
    three_language_gap: int = 8
    word_count: int = 9
    min_percent_of_words: int = 10
    min_weight: float = 0.00001

    def __post_init__(self):
        for name in ("min_percent", "three_language_gap", "min_percent_of_words"):
            _percent(name, getattr(self, name))
        if self.word_count < 0 or self.min_weight < 0:
            raise ValueError("word_count and min_weight must not be negative")

    @classmethod
    def shipped(cls) -> DetectorConfig:
        """The thresholds of the shipped applications."""
        return cls(word_count=5, min_percent_of_words=20)

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> DetectorConfig:
        return from_mapping(cls, values, {"min_percent": "ML_THRESHOLD_PERCENT", "three_language_gap": "ML_THRESHOLD_PERCENT_BETWEEN_3_LANGUAGE", "word_count": "ML_THRESHOLD_DETECTING_WORD_COUNT", "min_percent_of_words": "ML_THRESHOLD_PERCENT_DETECTING_WORD_COUNT", "min_weight": "ML_THRESHOLD_ABSOLUTE_WEIGHT_LANGUAGE"})


@dataclass(frozen=True)
class RussianConfig:
    """Thresholds of the Russian detector."""

    cyrillic_percent: int = 20
    threshold: float = 0.5

    def __post_init__(self):
        _percent("cyrillic_percent", self.cyrillic_percent)
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be from 0 to 1")

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> RussianConfig:
        return from_mapping(cls, values, {"cyrillic_percent": "RU_CYRILLIC_LETTERS_PERCENT", "threshold": "RU_THRESHOLD"})


#: Percent of the mass of n-grams kept, by order.
CUTS = {0: None, 1: {1: 95, 2: 50, 3: 15, 4: 5}, 2: {1: 50, 2: 15, 3: 5, 4: 2}}


@dataclass(frozen=True)
class TrainConfig:
    """What to train: n-grams up to `order`, cut 0 (none), 1 or 2, and the weighting."""

    order: int = 2
    cut: int = 1
    weighting: str = "tfidf"
    skip_cyrillic: bool = False
    gap: str = "reset"
    strict: bool = True

    def __post_init__(self):
        if self.weighting not in ("tfidf", "bm25", "residual_idf"):
            raise ValueError("weighting must be tfidf, bm25 or residual_idf")
        if self.order not in (1, 2, 3, 4) or self.cut not in CUTS:
            if self.strict:
                raise ValueError("order must be 1 to 4, cut 0 to 2")
            object.__setattr__(self, "order", self.order if self.order in (1, 2) else 2)
            object.__setattr__(self, "cut", self.cut if self.cut in (1, 2) else 1)

    @classmethod
    def all_models(cls) -> list[TrainConfig]:
        """n-grams up to 1 or 2 with cut 1 or 2."""
        return [cls(order=n, cut=c) for n in (1, 2) for c in (1, 2)]


def _list(value: str) -> tuple[str, ...]:
    return tuple(x for part in value.split(";") if (x := part.strip()))


@dataclass(frozen=True)
class BuilderConfig:
    """What a training run reads, makes and writes: one folder of the base folder for each group of languages."""

    input_folder: str = ""
    groups: tuple[str, ...] = ()
    groups_without_cyrillic: tuple[str, ...] = ()
    input_encoding: str = "utf-8"
    output_folder: str = ""
    output_encoding: str = "utf-8"
    all_models: bool = False
    train: TrainConfig = field(default_factory=TrainConfig)

    def __post_init__(self):
        for name in ("input_encoding", "output_encoding"):
            codecs.lookup(getattr(self, name))

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> BuilderConfig:
        """Orders and cuts other than 1 and 2 are corrected to 2 and 1. Sizes of portions and priorities have no meaning
        here: Spark spills and schedules."""
        base = from_mapping(cls, values, {"input_folder": "INPUT_BASE_FOLDER", "input_encoding": "INPUT_ENCODING", "output_folder": "OUTPUT_BASE_FOLDER", "output_encoding": "OUTPUT_ENCODING"})
        number = lambda key, default: int(re.sub(r"^\D*", "", values.get(key, "")) or default)
        order, cut = number("NGARMS", 2), number("CUT_THRESHOLD", 1)
        mode = values.get("BUILD_MODE", "single_model").strip().lower()
        if mode not in ("single_model", "all_possible_models"):
            raise ValueError(f"BUILD_MODE: {mode!r} is unknown")
        train = TrainConfig(order=order if order in (1, 2) else 2, cut=cut if cut in (1, 2) else 1, strict=False)
        return replace(base, groups=_list(values.get("INPUT_FOLDERS_BY_LANGUAGE", "")), groups_without_cyrillic=_list(values.get("CLEAR_CYRILLICS_CHARS_BY_LANGUAGE", "")), all_models=mode == "all_possible_models", train=train)


@dataclass(frozen=True)
class ConverterConfig:
    """What a conversion of text models to a binary one reads and writes."""

    text_files: Mapping[str, str] = field(default_factory=dict)
    output_name: str = "model"
    part_bytes: int = 25_690_112
    binary_folder: str = ""
    binary_files: tuple[str, ...] = ()

    @classmethod
    def from_mapping(cls, values: Mapping[str, str], languages: Iterable[str]) -> ConverterConfig:
        base = from_mapping(cls, values, {"output_name": "OUTPUT_FILE_NAME", "binary_folder": "BINARY_MODEL_FOLDER"})
        size = values.get("OUTPUT_FILE_SIZE_IN_BYTES", "")
        if size.strip().isdigit():
            base = replace(base, part_bytes=int(size))
        return replace(base, text_files=language_files(values, languages), binary_files=_list(values.get("BINARY_MODEL_FILE_NAMES", "")))


@dataclass(frozen=True)
class ServiceConfig:
    """Limits of a service: the longest text it is meant for, and how many requests it works on at once."""

    max_input_length: int = 1_000_000
    instances: int = 4

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> ServiceConfig:
        return from_mapping(cls, values, {"max_input_length": "MAX_INPUTTEXT_LENGTH", "instances": "CONCURRENT_FACTORY_INSTANCE_COUNT"})


def language_files(values: Mapping[str, str], languages: Iterable[str]) -> dict[str, str]:
    """The text model file of each language that has one, in the models' folder; that of Russian among many languages is
    named by `RU-ML`."""
    folder = values.get("LANGUAGE_MODELS_FOLDER", "").rstrip("/")
    got = {c: (values.get("RU-ML" if c == "RU" else c) or "").strip() for c in languages}
    return {c: f"{folder}/{f}" if folder else f for c, f in got.items() if f}


@dataclass(frozen=True)
class EngineConfig:
    """Where an engine's parts come from: a model in a format, text, binary or parquet, at a path or in files (`text_files`
    by language, `binary_files`), and a file of Russian n-grams."""

    model_path: str = ""
    model_format: str = "parquet"
    url_resources: str = ""
    text_files: Mapping[str, str] = field(default_factory=dict)
    binary_files: tuple[str, ...] = ()
    russian_file: str = ""
    detector: DetectorConfig = field(default_factory=DetectorConfig)
    russian: RussianConfig = field(default_factory=RussianConfig)

    def __post_init__(self):
        if self.model_format not in ("text", "binary", "parquet"):
            raise ValueError("model_format must be text, binary or parquet")

    @classmethod
    def from_mapping(cls, values: Mapping[str, str], languages: Iterable[str] = ()) -> EngineConfig:
        """`languages`: the codes that may name text model files."""
        base = from_mapping(cls, values, {"model_path": "LANGUAGE_MODELS_FOLDER", "model_format": "MODEL_FORMAT", "url_resources": "URL_DETECTOR_RESOURCES_XML_FILENAME"})
        files = language_files(values, languages)
        if files:
            base = replace(base, text_files=files, model_format="text")
        if russian := values.get("RU-RU", "").strip():
            base = replace(base, russian_file=f"{base.model_path.rstrip('/')}/{russian}" if base.model_path else russian)
        if folder := values.get("BINARY_MODEL_FOLDER"):
            parts = tuple(f"{folder.rstrip('/')}/{f}" for f in _list(values.get("BINARY_MODEL_FILE_NAMES", "")))
            base = replace(base, model_path=folder, model_format="binary", binary_files=parts)
        return replace(base, detector=DetectorConfig.from_mapping(values), russian=RussianConfig.from_mapping(values))
