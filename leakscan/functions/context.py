"""Where a text was headed, and what that does to a score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Exact hosts per destination kind, in order of priority.
DESTINATIONS = (
    ("paste_bin", ("pastebin.com", "paste.ee", "hastebin.com", "gist.github.com", "0bin.net")),
    ("code_host", ("github.com", "gist.github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "sr.ht", "git.sr.ht")),
    ("ai_code", ("copilot.github.com", "labs.openai.com", "cursor.so", "v0.dev")),
    ("ai_chat", ("chat.openai.com", "chatgpt.com", "claude.ai", "gemini.google.com", "bard.google.com",
                 "copilot.microsoft.com", "www.bing.com", "you.com", "www.perplexity.ai", "huggingface.co", "poe.com",
                 "chat.mistral.ai", "chat.qwen.ai")),
    ("social", ("twitter.com", "x.com", "facebook.com", "www.facebook.com", "linkedin.com", "www.linkedin.com",
                "reddit.com", "www.reddit.com")),
    ("email", ("mail.google.com", "outlook.live.com", "outlook.office.com", "mail.yahoo.com")),
)

# Path classes, first match wins. {s} is the start of a segment.
PATH_CLASSES = (
    ("test", r"{s}(?:tests?|__tests__|testdata)(?:/|\z)|_test\.|\.test\."),
    ("fixture", r"{s}fixtures?(?:/|\z)|\.fixture\."),
    ("spec", r"{s}specs?(?:/|\z)|_spec\.|\.spec\."),
    ("mock", r"{s}mocks?(?:/|\z)|{s}__mocks__(?:/|\z)|\.mock\."),
    ("docs", r"{s}(?:docs?|documentation|examples?|samples?)(?:/|\z)"),
)

# The destination mix of a realistic replay, in parts of 100, and its hosts.
REPLAY_MIX = ((40, "ai_chat", "contenteditable"), (70, "code_host", "contenteditable"),
              (90, "ai_code", "contenteditable"), (100, "ai_chat", "network_body"))
REPLAY_HOSTS = {
    "ai_chat": ("chat.openai.com", "chatgpt.com", "claude.ai", "gemini.google.com", "perplexity.ai", "mistral.ai",
                "poe.com", "you.com"),
    "code_host": ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "sourcehut.org"),
    "ai_code": ("copilot.microsoft.com", "cursor.com", "codeium.com", "tabnine.com"),
}

SOURCE_FIELDS = ("destination_kind", "destination_host", "element_kind", "in_code_fence", "language_hint",
                 "path_hint", "surrounding_hash", "page_url_hash")


def classify_destination(host: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, hosts in reversed(DESTINATIONS):
        kind = F.when(host.isin(*hosts), name).otherwise(kind)
    return F.coalesce(kind, F.lit("unknown"))


def _path_class(path: Column, segment_start: str) -> Column:
    found = F.lit("")
    for name, regex in reversed(PATH_CLASSES):
        found = F.when(path.rlike("(?i)" + regex.replace("{s}", segment_start)), name).otherwise(found)
    return F.when(path.isNull(), F.lit("")).otherwise(found)


def path_hint(pathname: Column) -> Column:
    """Class of a URL path, whose segments all follow a slash."""
    return _path_class(pathname, "/")


def classify_path(path: Column) -> Column:
    """Class of a file path, which may also start with a segment."""
    return _path_class(path, r"(?:/|\A)")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def surrounding_hash(content: Column, host: Column, element_kind: Column) -> Column:
    return short_hash(F.concat_ws("|", F.coalesce(content, F.lit("")), host, element_kind))


def page_url_hash(host: Column, path: Column) -> Column:
    return short_hash(F.concat(host, path))


def url_host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def url_path(url: Column) -> Column:
    """Path of a URL; '/' where a web URL has none, as browsers report it."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when((path == "") & (url_host(url) != ""), F.lit("/")).otherwise(path)


def source_context(url: Column, element_kind: Column, content: Column,
                   in_code_fence: Column | None = None, language_hint: Column | None = None) -> Column:
    """The eight-field context struct of a record sent to ``url``."""
    host, path = url_host(url), url_path(url)
    return F.struct(
        classify_destination(host).alias("destination_kind"),
        host.alias("destination_host"),
        element_kind.alias("element_kind"),
        (in_code_fence if in_code_fence is not None else F.lit(False)).alias("in_code_fence"),
        (language_hint if language_hint is not None else F.lit("")).alias("language_hint"),
        path_hint(path).alias("path_hint"),
        surrounding_hash(content, host, element_kind).alias("surrounding_hash"),
        page_url_hash(host, path).alias("page_url_hash"),
    )


def replay_source(mix: str, path: Column, *key: Column, seed: int = 1) -> Column:
    """Context of a replayed corpus line: always a code host, or drawn from the realistic mix.

    The draw is a hash of the key, so a line gets the same context in every run.
    """
    hint = classify_path(path)

    def struct(kind: Column, host: Column, element: Column) -> Column:
        return F.struct(kind.alias("destination_kind"), host.alias("destination_host"), element.alias("element_kind"),
                        hint.alias("path_hint"))

    if mix == "worst":
        return struct(F.lit("code_host"), F.lit("github.com"), F.lit("contenteditable"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
    draw = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100))
    pick = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    kind, host, element = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for upper, name, how in reversed(REPLAY_MIX):
        hosts = F.array(*[F.lit(h) for h in REPLAY_HOSTS[name]])
        kind = F.when(draw < upper, name).otherwise(kind)
        host = F.when(draw < upper, F.get(hosts, F.pmod(pick, F.lit(len(REPLAY_HOSTS[name]))).cast("int"))).otherwise(host)
        element = F.when(draw < upper, how).otherwise(element)
    return struct(kind, host, element)


def destination_bias(rule_bias: Column, kind: Column) -> Column:
    """A pattern's own bias for the destination, else the general one; none without a destination."""
    general = F.when(kind == "code_host", -2).otherwise(0)
    return F.when(kind == "", 0).otherwise(F.coalesce(F.try_element_at(rule_bias, kind), general))


def element_bias(element_kind: Column) -> Column:
    return F.when(element_kind == "network_body", 1).otherwise(0)


def code_fence_bias(severity: Column, in_code_fence: Column) -> Column:
    return F.when(in_code_fence & severity.isin("medium", "low"), -1).otherwise(0)


def language_bias(hint: Column) -> Column:
    return F.when(F.lower(F.trim(hint)).isin("test", "fixture", "spec"), -1).otherwise(0)


def path_bias(kind: Column, hint: Column) -> Column:
    return F.when((kind == "code_host") & F.lower(F.trim(hint)).isin("test", "fixture", "spec", "mock"), -1).otherwise(0)


def source_columns(source: Column, fields: list[str]) -> dict[str, Column]:
    """Every context field as a column of its own, NULLs filled; ``fields`` are those the struct has."""

    def take(name: str) -> Column:
        empty = F.lit(False) if name == "in_code_fence" else F.lit("")
        return F.coalesce(source[name], empty) if name in fields else empty

    return {f"_ctx_{name}": take(name) for name in SOURCE_FIELDS[:6]}


def source_struct() -> Column:
    return F.struct(*[F.col(f"_ctx_{name}").alias(name) for name in SOURCE_FIELDS[:6]])


def source_bias(rule: Column, source: Column) -> Column:
    """Sum of the five biases. Every one of them is 0 for an empty context."""
    kind = source["destination_kind"]
    return (
        destination_bias(rule["context_bias"], kind)
        + element_bias(source["element_kind"])
        + code_fence_bias(rule["severity"], source["in_code_fence"])
        + language_bias(source["language_hint"])
        + path_bias(kind, source["path_hint"])
    )
