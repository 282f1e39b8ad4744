"""Encodings, their split patterns and special tokens, and which models use which."""

from __future__ import annotations

from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: split patterns of the public encodings
R50K = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CL100K = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""
O200K = "|".join(
    (
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    )
)
GPT4 = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
# fixed values: special tokens and vocabulary sizes
END, END_PROMPT = "<|endoftext|>", "<|endofprompt|>"
FIM = ("<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>")


@dataclass(frozen=True)
class Spec:
    """What is fixed about an encoding; ranks names the rank file it reads."""

    name: str
    pattern: str
    n_vocab: int
    specials: MappingProxyType
    ranks: str


def _spec(name: str, pattern: str, n_vocab: int, specials: dict[str, int], ranks: str | None = None) -> tuple[str, Spec]:
    return name, Spec(name, pattern, n_vocab, MappingProxyType(specials), ranks or name)


SPECS = dict(
    (
        _spec("o200k_base", O200K, 200019, {END: 199999, END_PROMPT: 200018}),
        _spec("o200k_harmony", O200K, 200019, {END: 199999, END_PROMPT: 200018}, "o200k_base"),
        _spec("cl100k_base", CL100K, 100277, {END: 100257, FIM[0]: 100258, FIM[1]: 100259, FIM[2]: 100260, END_PROMPT: 100276}),
        _spec("p50k_base", R50K, 50281, {END: 50256}),
        _spec("p50k_edit", R50K, 50281, {END: 50256}, "p50k_base"),
        _spec("r50k_base", R50K, 50257, {END: 50256}),
        _spec("gpt2", R50K, 50257, {END: 50256}, "r50k_base"),
    )
)
# fixed values: models and their encodings, and prefixes in the order they are tried
MODELS = {
    "o1": "o200k_base",
    "o3": "o200k_base",
    "o4-mini": "o200k_base",
    "gpt-5": "o200k_base",
    "gpt-4.1": "o200k_base",
    "gpt-4o": "o200k_base",
    "gpt-4o-mini": "o200k_base",
    "gpt-4.1-mini": "o200k_base",
    "gpt-4.1-nano": "o200k_base",
    "gpt-oss-120b": "o200k_harmony",
    "gpt-4": "cl100k_base",
    "gpt-3.5-turbo": "cl100k_base",
    "gpt-3.5": "cl100k_base",
    "gpt-35-turbo": "cl100k_base",
    "davinci-002": "cl100k_base",
    "babbage-002": "cl100k_base",
    "text-embedding-ada-002": "cl100k_base",
    "text-embedding-3-small": "cl100k_base",
    "text-embedding-3-large": "cl100k_base",
    "text-davinci-003": "p50k_base",
    "text-davinci-002": "p50k_base",
    "code-davinci-002": "p50k_base",
    "code-davinci-001": "p50k_base",
    "code-cushman-002": "p50k_base",
    "code-cushman-001": "p50k_base",
    "davinci-codex": "p50k_base",
    "cushman-codex": "p50k_base",
    "text-davinci-edit-001": "p50k_edit",
    "code-davinci-edit-001": "p50k_edit",
    "text-davinci-001": "r50k_base",
    "text-curie-001": "r50k_base",
    "text-babbage-001": "r50k_base",
    "text-ada-001": "r50k_base",
    "davinci": "r50k_base",
    "curie": "r50k_base",
    "babbage": "r50k_base",
    "ada": "r50k_base",
    "text-similarity-davinci-001": "r50k_base",
    "text-similarity-curie-001": "r50k_base",
    "text-similarity-babbage-001": "r50k_base",
    "text-similarity-ada-001": "r50k_base",
    "text-search-davinci-doc-001": "r50k_base",
    "text-search-curie-doc-001": "r50k_base",
    "text-search-babbage-doc-001": "r50k_base",
    "text-search-ada-doc-001": "r50k_base",
    "code-search-babbage-code-001": "r50k_base",
    "code-search-ada-code-001": "r50k_base",
    "gpt-2": "r50k_base",
    "gpt2": "gpt2",
}
PREFIXES = (
    ("o1-", "o200k_base"), ("o3-", "o200k_base"), ("o4-mini-", "o200k_base"), ("gpt-5-", "o200k_base"), ("gpt-4.5-", "o200k_base"), ("gpt-4.1-", "o200k_base"),
    ("chatgpt-4o-", "o200k_base"), ("gpt-4o-", "o200k_base"), ("gpt-oss-", "o200k_harmony"), ("gpt-4-", "cl100k_base"), ("gpt-3.5-turbo-", "cl100k_base"),
    ("gpt-35-turbo-", "cl100k_base"), ("ft:gpt-4o", "o200k_base"), ("ft:gpt-4", "cl100k_base"), ("ft:gpt-3.5-turbo", "cl100k_base"), ("ft:davinci-002", "cl100k_base"),
    ("ft:babbage-002", "cl100k_base"),
)


def spec_of(name: str) -> Spec:
    if name not in SPECS:
        raise ValueError(f"unknown encoding {name!r}; there are {', '.join(sorted(SPECS))}")
    return SPECS[name]


def list_encoding_names() -> list[str]:
    return sorted(SPECS)


def list_models() -> list[str]:
    return sorted(MODELS)


def model_to_encoding(model: str) -> str:
    """The encoding of a model: by its name, else by the first prefix that fits."""
    got = MODELS.get(model) or next((e for p, e in PREFIXES if model.startswith(p)), None)
    if got is None:
        raise KeyError(f"no encoding is known for model {model!r}; name one with get_encoding()")
    return got


def model_encoding_column(model: Column) -> Column:
    """model_to_encoding() of a column; null where nothing fits."""
    exact = F.element_at(F.create_map(*(F.lit(x) for pair in MODELS.items() for x in pair)), model)
    return F.coalesce(exact, *(F.when(model.startswith(p), e) for p, e in PREFIXES))


def encodings_table(spark: SparkSession) -> DataFrame:
    rows = [(s.name, s.n_vocab, s.specials[END], s.ranks, len(s.specials)) for s in SPECS.values()]
    return spark.createDataFrame(rows, "name string, n_vocab int, eot_token int, rank_file string, n_specials int")


def models_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS.items()), "model string, encoding string")
