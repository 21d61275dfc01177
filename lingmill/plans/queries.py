"""Queries of the reference's operators and of the general problems, each over its whole tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingmill.config import DetectorConfig, EngineConfig
from lingmill.functions import chars, cyrillic
from lingmill.functions import urls as U
from lingmill.functions.ngrams import explode_ngrams, previous
from lingmill.functions.tokenize import simple_tokens, tokens
from lingmill.operators import detect as D
from lingmill.operators import model as M
from lingmill.operators import russian as R
from lingmill.operators import train as T
from lingmill.plans.engine import Engine
from lingmill.session import cut_lineage, shared_folder, spread, table
from lingmill.sources import model_files, model_text
from lingmill.streaming.detect import detect_stream


def _round(col: str, digits: int = 6):
    return F.round(F.col(col), digits).alias(col)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lang_samples").select("sample_id", "language", tokens(F.col("text")).alias("tokens"))


def _training(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).filter("language is not null").select(F.lit("all").alias("grp"), F.col("language").alias("doc"), "tokens")


def _model(spark: SparkSession, d: str) -> DataFrame:
    """A model trained on the labelled samples: 1- and 2-grams, cut 1, TF-IDF."""
    return cut_lineage(T.train(_training(spark, d)).select("ngram", F.col("doc").alias("lang"), "weight"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests with tokens; URLs are no words."""
    return spread(table(spark, d, "requests").select("req_id", "text")).withColumn("tokens", tokens(F.col("text"), U.UrlRules.default()))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """The spilled partial counts, merged: (grp, doc, n, ngram, cnt)."""
    rows = table(spark, d, "word_t").filter(~chars.is_blank(F.col("value")) & (F.col("count") >= 1))
    return rows.groupBy("grp", "doc", "n", F.col("value").alias("ngram")).agg(F.sum(F.col("count").cast("long")).alias("cnt"))


# problem 3


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return model_text.parse_lines(spread(table(spark, d, "model_lines"))).filter("reason is not null").select("line_id")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return model_text.parse_lines(spread(table(spark, d, "model_lines"))).filter("not is_header and reason is null").select("line_id", "text", "weight")


# tokens, URLs, characters


def tokens_samples(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("sample_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("words"))


def tokens_requests(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).filter("text is not null").select("req_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("words"))


def tokens_per_doc(spark: SparkSession, d: str) -> DataFrame:
    rules = U.UrlRules.default()
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(tokens(F.col("text"), rules)).alias("n_tokens"))


def simple_tokenizer(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "lang_samples").select("sample_id", simple_tokens(F.col("text")).alias("t"))
    return terms.select("sample_id", F.size("t").alias("n_terms"), F.size(F.filter("t", lambda x: x.isNull())).alias("n_null"), F.array_join("t", "|").alias("terms"))


def url_spans_requests(spark: SparkSession, d: str) -> DataFrame:
    rules = U.UrlRules.default()
    spans = spread(table(spark, d, "requests").select("req_id", "text")).select("req_id", F.explode(U.url_spans(F.col("text"), rules)).alias("u"))
    return spans.select("req_id", "u.start", "u.length", "u.value")


def url_mask_counts(spark: SparkSession, d: str) -> DataFrame:
    rules = U.UrlRules.default()
    masked = U.url_mask(F.col("text"), rules)
    rows = spread(table(spark, d, "documents").select("source", "text")).select("source", (F.length("text") - F.length(F.replace(masked, F.lit(chars.SPLIT_MARK), F.lit("")))).alias("hidden"))
    return rows.groupBy("source").agg(F.sum("hidden").alias("url_chars"))


def character_counts(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each class in every request."""
    t = F.col("text")
    count = lambda cls: F.length(t) - F.length(F.regexp_replace(t, cls, ""))
    return table(spark, d, "requests").select("req_id", count("\\p{L}").alias("letters"), count("\\p{Nd}").alias("digits"), count("\\p{P}").alias("punctuation"), count(f"[{chars.WHITE}]").alias("white"), chars.is_blank(t).alias("is_blank"))


def display_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "requests").select("req_id", chars.cut(chars.squeeze(t), 40).alias("shown"))


def upper_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_pairs").select("pair_id", chars.upper(F.col("text")).alias("ngram"))


# n-grams and training


def _gram_counts(spark: SparkSession, d: str, n: int) -> DataFrame:
    return explode_ngrams(_samples(spark, d), ["language"], "tokens", (n,)).groupBy("language", "ngram").agg(F.count("*").alias("cnt"))


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return _gram_counts(spark, d, 1)


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _gram_counts(spark, d, 2)


def ngram3_counts(spark: SparkSession, d: str) -> DataFrame:
    return _gram_counts(spark, d, 3)


def ngram4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _gram_counts(spark, d, 4)


def merged_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def cut1_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.cut_counts(cut_lineage(_counts(spark, d)), 1)


def cut2_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.cut_counts(cut_lineage(_counts(spark, d)), 2)


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return T.document_frequency(_counts(spark, d))


def tf(spark: SparkSession, d: str) -> DataFrame:
    return T.term_frequency(_counts(spark, d)).select("grp", "doc", "ngram", "cnt", _round("tf"))


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return T.tfidf(_counts(spark, d)).select("grp", "doc", "ngram", _round("weight"))


def tfidf_one_dimension(spark: SparkSession, d: str) -> DataFrame:
    return T.tfidf_one_dimension(_counts(spark, d), 10_000, "en-megacorpus.txt").select("grp", "doc", "ngram", _round("weight"))


def bm25(spark: SparkSession, d: str) -> DataFrame:
    return T.bm25(_counts(spark, d)).select("grp", "doc", "ngram", _round("weight"))


def residual_idf(spark: SparkSession, d: str) -> DataFrame:
    return T.residual_idf(_counts(spark, d)).select("grp", "doc", "ngram", _round("weight"), (F.round("absent", 6) + F.lit(0.0)).alias("absent"))


def most_frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent n-grams of each document and order."""
    return T.most_frequent(_counts(spark, d), 10)


def previous_terms(spark: SparkSession, d: str) -> DataFrame:
    """Each word of the samples with the one before it."""
    rows = _samples(spark, d).select("sample_id", F.posexplode(F.arrays_zip(F.col("tokens").alias("term"), previous(F.col("tokens")).alias("before"))).alias("pos", "x"))
    return rows.select("sample_id", "pos", F.col("x.term").alias("term"), F.col("x.before").alias("before"))


def average_length(spark: SparkSession, d: str) -> DataFrame:
    length = _counts(spark, d).groupBy("grp", "doc").agg(F.sum("cnt").alias("dl"))
    return length.groupBy("grp").agg(F.round(F.avg("dl"), 6).alias("avgdl"), F.count("*").alias("n_docs"))


def trained_model(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).select("ngram", "lang", _round("weight"))


def all_models_sizes(spark: SparkSession, d: str) -> DataFrame:
    return T.train_all(_training(spark, d)).groupBy("order", "cut", "doc").agg(F.count("*").alias("n"))


def skip_cyrillic_counts(spark: SparkSession, d: str) -> DataFrame:
    """2-grams of requests without Cyrillic words, over which no n-gram reaches."""
    docs = _requests(spark, d).select(F.lit("requests").alias("grp"), F.lit("all").alias("doc"), "tokens")
    return T.count_ngrams(docs, 2, F.lit(True), "reset").filter("n = 2").select("ngram", "cnt")


def _sample_lines(spark: SparkSession, d: str) -> DataFrame:
    """The samples as the lines of one file for each language."""
    return _samples(spark, d).filter("language is not null").select(F.lit("all").alias("grp"), F.col("language").alias("doc"), F.col("sample_id").alias("line_no"), "tokens")


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """1- to 4-grams of files of lines; n-grams reach over the ends of lines."""
    counts = T.count_ngrams(_sample_lines(spark, d), 4, line_col="line_no")
    return counts.select(F.col("doc").alias("language"), F.col("n").cast("int").alias("n"), "ngram", "cnt")


def lines_model(spark: SparkSession, d: str) -> DataFrame:
    """A model trained on files of lines."""
    return T.train(_sample_lines(spark, d), line_col="line_no").select("ngram", F.col("doc").alias("lang"), _round("weight"))


def document_line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Different and all 1- and 2-grams of the documents' lines, tokenized line by line, by the documents' label; the
    documents of a label are read as one file."""
    docs = spread(table(spark, d, "documents").select("lang", "doc_id", "text").filter("text is not null"))
    lines = T.split_lines(docs, ["lang"], "doc_id", "text").select(F.lit("all").alias("grp"), F.col("lang").alias("doc"), "line_no", tokens(F.col("text"), U.UrlRules.default()).alias("tokens"))
    counts = T.count_ngrams(lines, 2, line_col="line_no")
    return counts.groupBy(F.col("doc").alias("lang"), F.col("n").cast("int").alias("n")).agg(F.count("*").alias("n_ngrams"), F.sum("cnt").alias("total"), F.max("cnt").alias("most"))


def empty_documents(spark: SparkSession, d: str) -> DataFrame:
    return T.empty_documents(_requests(spark, d).select(F.lit("requests").alias("grp"), F.col("req_id").alias("doc"), "tokens")).select(F.col("doc").alias("req_id"))


# models


def _pairs(spark: SparkSession, d: str, version: str | None = None) -> DataFrame:
    rows = table(spark, d, "model_pairs")
    return M.from_long(rows.filter(F.col("file_name").contains(f"-{version}-")) if version else rows, "text", "language", "weight")


def model_record_count(spark: SparkSession, d: str) -> DataFrame:
    return M.record_count(_pairs(spark, d))


def model_nested(spark: SparkSession, d: str) -> DataFrame:
    one = F.transform("langs", lambda x: F.concat(x["lang"], F.lit(":"), F.round(x["weight"] * 1_000_000).cast("long").cast("string")))
    return M.nested(_pairs(spark, d)).select("ngram", F.size("langs").alias("n"), F.array_join(F.sort_array(one), ",").alias("langs"))


def model_merged(spark: SparkSession, d: str) -> DataFrame:
    return M.merged(_pairs(spark, d)).select("ngram", "lang", _round("weight"), "hits")


def model_compare(spark: SparkSession, d: str) -> DataFrame:
    return M.compare(_pairs(spark, d, "v1"), _pairs(spark, d, "v2"))


def vocab_intersect(spark: SparkSession, d: str) -> DataFrame:
    return M.intersect(_pairs(spark, d, "v1"), _pairs(spark, d, "v2"))


def vocab_except(spark: SparkSession, d: str) -> DataFrame:
    return M.difference(_pairs(spark, d, "v1"), _pairs(spark, d, "v2"))


def model_occurring(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "word_t").select(F.col("value").alias("ngram"))
    return M.occurring(_pairs(spark, d), seen).groupBy("ngram", "lang").agg(F.count("*").alias("n"))


def model_binary_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Differences between a model and the one read back from its binary files: none."""
    ids = {r["code"]: r["lang_id"] for r in table(spark, d, "languages").limit(256).collect()}
    model = _pairs(spark, d).withColumn("weight", F.col("weight").cast("float").cast("double"))
    path = shared_folder(spark, "binary-model")
    model_files.write_binary_model(model, ids, path)
    return M.compare(model, model_files.read_binary_model(spark, path, ids))


def model_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Differences between a trained model, with float weights, and the one read back from its text files: none."""
    model = T.train(_training(spark, d))
    path = shared_folder(spark, "text-model")
    files = model_files.write_text_model(model.withColumn("doc", F.concat("doc", F.lit(".txt"))), path)
    by_lang: dict[str, list[str]] = {}
    for f in files:
        by_lang.setdefault(f.rsplit("/", 1)[1][:2], []).append(f)
    back = model_files.read_text_model(spark, by_lang)
    return M.compare(model.select("ngram", F.col("doc").alias("lang"), F.col("weight").cast("float").cast("double").alias("weight")), back)


# detection


def lang_scores(spark: SparkSession, d: str) -> DataFrame:
    return D.scores(_requests(spark, d), _model(spark, d), "req_id").select("req_id", "terms", "detected", "lang", _round("weight_sum"), "hits")


def detect_long(spark: SparkSession, d: str) -> DataFrame:
    return D.long_form(D.detect(_requests(spark, d), _model(spark, d), "req_id"), "req_id").select("req_id", "rank", "lang", _round("weight"), "percent")


def detect_top(spark: SparkSession, d: str) -> DataFrame:
    return D.top(D.detect(_requests(spark, d), _model(spark, d), "req_id"), "req_id")


def detect_shipped(spark: SparkSession, d: str) -> DataFrame:
    return D.top(D.detect(_requests(spark, d), _model(spark, d), "req_id", config=DetectorConfig.shipped()), "req_id")


def detect_unknown_reason(spark: SparkSession, d: str) -> DataFrame:
    return D.detect(_requests(spark, d), _model(spark, d), "req_id").groupBy("reason").agg(F.count("*").alias("n"))


def detect_documents(spark: SparkSession, d: str) -> DataFrame:
    rules = U.UrlRules.default()
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("tokens", tokens(F.col("text"), rules))
    return D.top(D.detect(docs, _model(spark, d), "doc_id"), "doc_id")


def detect_local(spark: SparkSession, d: str) -> DataFrame:
    """Row-local detection of requests, as on a stream."""
    local = D.LocalDetector(_model(spark, d))
    return D.top(detect_stream(spread(table(spark, d, "requests").select("req_id", "text")), local, U.UrlRules.default()), "req_id")


def detect_joined(spark: SparkSession, d: str) -> DataFrame:
    """Detection by joins, the form for models too large to be looked up."""
    return D.top(D.detect(_requests(spark, d), _model(spark, d), "req_id", local_bytes=0), "req_id")


def detect_engine(spark: SparkSession, d: str) -> DataFrame:
    """Detection through an engine made from settings and a saved model."""
    path = shared_folder(spark, "engine-model")
    model_files.save_model(_model(spark, d), path)
    engine = Engine.create(spark, EngineConfig(model_path=path))
    return D.top(engine.detect(spread(table(spark, d, "requests").select("req_id", "text")), "req_id"), "req_id")


def detect_json(spark: SparkSession, d: str) -> DataFrame:
    names = {r["code"]: r["name"] for r in table(spark, d, "languages").limit(256).collect()}
    docs = _requests(spark, d)
    got = D.detect(docs, _model(spark, d), "req_id").join(docs.select("req_id", F.when(F.col("text").isNull(), "no text").alias("error")), "req_id")
    return got.select("req_id", D.as_json(F.col("langs"), names, F.col("error")).alias("answer"), D.as_text(F.col("langs")).alias("shown"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Best language by the label of the service's first answer."""
    best = detect_top(spark, d)
    answers = table(spark, d, "responses").filter("rank_no = 1").groupBy("req_id").agg(F.max_by("l", F.struct("logged_at", "resp_id")).alias("label"))
    return best.join(answers, "req_id", "left").groupBy("label", "lang").agg(F.count("*").alias("n"))


def accuracy_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Share of clean samples whose language is found, the model being trained on other samples (sample_id not divisible by 5)."""
    rows = _samples(spark, d)
    held = F.col("sample_id") % 5 == 0
    model = T.train(rows.filter(~held).select(F.lit("all").alias("grp"), F.col("language").alias("doc"), "tokens")).select("ngram", F.col("doc").alias("lang"), "weight")
    best = D.top(D.detect(rows.filter(held), model, "sample_id"), "sample_id")
    return best.join(rows.select("sample_id", "language"), "sample_id").groupBy("language").agg(F.count("*").alias("n"), F.sum(F.when(F.col("lang") == F.col("language"), 1).otherwise(0)).alias("n_right"))


def cyrillic_gate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "requests").filter(~chars.is_blank(t)).select("req_id", cyrillic.has_cyrillic_letters(t, 20).alias("gate"), cyrillic.cyrillic_percent(t).alias("percent"), cyrillic.has_cyrillic_char(t).alias("any_cyrillic"))


def ru_score(spark: SparkSession, d: str) -> DataFrame:
    words = R.russian_vocabulary(_model(spark, d).filter("lang = 'RU'"))
    got = R.detect_ru(_requests(spark, d), words, "req_id")
    return got.select("req_id", "gate", _round("weight"), "is_russian")


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_loaded, tokens_samples, tokens_requests, tokens_per_doc, simple_tokenizer, url_spans_requests, url_mask_counts, character_counts, display_texts, upper_words,
        term_counts, bigram_counts, ngram3_counts, ngram4_counts, merged_counts, cut1_counts, cut2_counts, document_frequency, tf, tfidf, tfidf_one_dimension, bm25, residual_idf,
        average_length, most_frequent_terms, previous_terms, trained_model, all_models_sizes, skip_cyrillic_counts, line_counts, lines_model, document_line_counts, empty_documents, model_record_count, model_nested, model_merged, model_compare, vocab_intersect,
        vocab_except, model_occurring, model_binary_roundtrip, model_text_roundtrip, lang_scores, detect_long, detect_top, detect_shipped, detect_unknown_reason, detect_documents,
        detect_local, detect_joined, detect_engine, detect_json, confusion_matrix, accuracy_by_language, cyrillic_gate, ru_score,
    )
}
