"""Chat conversations: templates, rendering and their segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "roles_v1"
# fixed values: the two built-in templates
TEMPLATES = {
    "roles_v1": {"message_prefix": "[[role:{role}]]\n", "message_suffix": "\n[[/message]]\n", "assistant_prefix": "[[role:{role}]]\n"},
    "im_tokens": {"message_prefix": "<|im_start|>{role}\n", "message_suffix": "<|im_end|>\n", "assistant_prefix": "<|im_start|>{role}\n"},
}


def resolve_template(template: str | Mapping[str, str] | None = DEFAULT) -> dict[str, str | None]:
    if template is None:
        return dict(TEMPLATES[DEFAULT])
    if isinstance(template, str) and template in TEMPLATES:
        return dict(TEMPLATES[template])
    if not isinstance(template, Mapping):
        raise ValueError(f"a chat template is one of {', '.join(TEMPLATES)}, or a mapping")
    prefix, suffix, prime = template.get("message_prefix"), template.get("message_suffix", ""), template.get("assistant_prefix")
    if not isinstance(prefix, str) or not prefix:
        raise ValueError("a chat template needs a message_prefix that isn't empty")
    if not isinstance(suffix, str) or not isinstance(prime, str | None):
        raise ValueError("message_suffix must be a string, and assistant_prefix a string or None")
    return {"message_prefix": prefix, "message_suffix": suffix, "assistant_prefix": prime}


def implied_specials(config: Mapping[str, str | None], specials: Iterable[str]) -> set[str]:
    """Special tokens that the template itself writes; they are allowed in contents too."""
    probe = [x.replace("{role}", "assistant") for x in config.values() if x]
    return {s for s in specials if s and any(s in x for x in probe)}


def segments(messages: Iterable[Mapping], config: Mapping[str, str | None], prime: str | None = "assistant") -> Iterator[str]:
    for m in messages:
        if not isinstance(m, Mapping):
            raise TypeError("a chat message is a mapping with role, name and content")
        role, content = m.get("name", m.get("role", "user")), m.get("content", "")
        yield config["message_prefix"].replace("{role}", role if isinstance(role, str) and role else "user")
        if content is not None and (text := str(content)):
            yield text
        yield config["message_suffix"]
    if prime and config["assistant_prefix"]:
        yield config["assistant_prefix"].replace("{role}", prime)


def message_segments(role: Column, content: Column, config: Mapping[str, str | None], name: Column | None = None) -> Column:
    """The segments of one message of a long table. A name that isn't null takes the role's place."""
    r = role if name is None else F.coalesce(name, role)
    r = F.when(F.coalesce(r, F.lit("")) == "", "user").otherwise(r)
    c = F.coalesce(content, F.lit(""))
    return F.filter(F.array(F.replace(F.lit(config["message_prefix"]), F.lit("{role}"), r), c, F.lit(config["message_suffix"])), lambda x: x != "")


def conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template=DEFAULT, prime: str | None = "assistant", name_col: str | None = None) -> DataFrame:
    """(conv, segments): each conversation's segments in the order of its turns. A conversation is one group: its turns meet in one row."""
    config = resolve_template(template)
    one = df.select(conv_col, F.struct(F.col(turn_col), message_segments(F.col(role_col), F.col(text_col), config, F.col(name_col) if name_col else None).alias("s")).alias("m"))
    tail = F.array(F.lit(config["assistant_prefix"].replace("{role}", prime))) if prime and config["assistant_prefix"] else F.array().cast("array<string>")
    return one.groupBy(conv_col).agg(F.concat(F.flatten(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["s"])), tail).alias("segments"))


def rendered(segments_: Column) -> Column:
    return F.array_join(segments_, "")
