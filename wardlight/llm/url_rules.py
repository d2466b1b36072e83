"""URL filters: pattern rules indexed by their rarest literal token.

A *host* rule ``host/path`` fits the URLs of that host and its subdomains whose
path starts with its path; an empty host is any host, and a rule without a
slash has no path to ask for.  A *pattern* rule is looked for in the whole URL:
``*`` stands for any run of characters, ``^`` for one character that is no
letter, digit or ``_.%-`` (or for the end), ``|`` at either end ties the rule to
that end of the URL.

Every rule becomes a regular expression, and is filed under one literal token
(a run of ASCII letters and digits, case folded) that any fitting URL must hold
whole: the one that the fewest URLs of the table hold, which Spark counts.
Rules without such a token are filed under none and tried for each URL.  A
URL's tokens fetch its candidates; only these run their regular expressions,
in order of precedence, until one fits: host rules before pattern rules, longer
rules first, then ``allow`` before ``block``, then by text.  Without a fitting
rule the verdict is ``default``.

The host is what lies between the first ``://`` and the next ``/``, ``?``, ``#``
or the end, A-Z lower-cased; the path goes on to the next ``?``, ``#`` or the
end.  Rules travel to the tasks, so their bytes are bounded (``MAX_BYTES``).

Null URLs and those without ``://`` have an empty host and path and may still
hold a pattern (null URLs hold none).  Very long URLs are read whole; wildcards
never back up, so the work is linear in the URL for each piece of a rule.
Repeated rows are judged alike, ties between rules are settled above, an empty
table gives an empty result, and a column of the input that has the name of a
new one gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, FOLDED)
TOKEN = "[a-z0-9]+"
SEPARATOR = r"(?:[^A-Za-z0-9_.%\-]|\Z)"
MAX_BYTES = 64 << 20
ADDED = "host string, path string, rule string, pattern string, verdict string"


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    text: str
    kind: str = "host"  # or pattern

    def __post_init__(self):
        if self.action not in ("allow", "block") or self.kind not in ("host", "pattern") or not self.text:
            raise ValueError(f"not a rule: {self}")

    def precedence(self) -> tuple:
        return self.kind != "host", -len(self.text), self.action, self.text

    def expression(self) -> str:
        """Matched from the start of ``host + path`` (host rules) or of the URL."""
        if self.kind == "host":
            host, slash, path = self.text.partition("/")
            head = r"(?:[^/]*\.)?" + re.escape(host.translate(FOLD)) if host else "[^/]*"
            return head + (re.escape(slash + path) if slash else r"(?=/|\Z)")
        body, tied, ends = _edges(self.text)
        pieces = ["".join(SEPARATOR if c == "^" else re.escape(c) for c in part) for part in body.split("*")]
        parts = [f"(?>.*?{piece})" for piece in pieces]
        if ends:  # the last piece lies at the end, wherever it is met before
            parts[-1] = rf".*{pieces[-1]}\Z"
        if tied:
            parts[0] = pieces[0] + (r"\Z" if ends and len(pieces) == 1 else "")
        return "".join(parts)

    def tokens(self) -> list[str]:
        """Literal tokens that a fitting URL holds whole."""
        if self.kind == "host":
            text, open_end = self.text.translate(FOLD), "/" in self.text
            return [m[0] for m in re.finditer(TOKEN, text) if not (open_end and m.end() == len(text))]
        body, tied, ends = _edges(self.text.translate(FOLD))
        parts = body.split("*")
        found = []
        for k, part in enumerate(parts):
            left = tied and k == 0
            right = ends and k == len(parts) - 1
            found += [m[0] for m in re.finditer(TOKEN, part) if (left or m.start() > 0) and (right or m.end() < len(part))]
        return found


def _edges(text: str) -> tuple[str, bool, bool]:
    tied = text.startswith("|")
    ends = len(text) > 1 and text.endswith("|")
    return text[tied : len(text) - ends], tied, ends


def split(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match("[^?#]*", rest[len(host) :])[0]


def tokens_of(url: str) -> set[str]:
    return set(re.findall(TOKEN, url.translate(FOLD)))


def token_counts(urls: DataFrame, rules: Sequence[Rule], column: str = "url") -> dict[str, int]:
    """How many rows hold each token of the rules; as many entries as the rules have tokens."""
    wanted = sorted({t for rule in rules for t in rule.tokens()})
    if not wanted:
        return {}
    folded = F.translate(column, UPPER, FOLDED)
    held = F.array_intersect(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)), F.array(*map(F.lit, wanted)))
    if len(wanted) > 1000:  # too long for a literal: meet the tokens as a table
        spark = urls.sparkSession
        table = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string"))  # at most MAX_BYTES
        tokens = F.array_distinct(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)))
        rows = urls.select(F.explode(tokens).alias("token")).join(table, "token")
    else:
        rows = urls.select(F.explode(held).alias("token"))
    return {r.token: r["count"] for r in rows.groupBy("token").count().collect()}


class Index:
    """Compiled rules in order of precedence, filed by their rarest token."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.rules = sorted(set(rules), key=Rule.precedence)
        self.expressions = [re.compile(r.expression(), re.DOTALL) for r in self.rules]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for number, rule in enumerate(self.rules):
            tokens = rule.tokens()
            if tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(number)
            else:
                self.always.append(number)

    def candidates(self, url: str) -> list[int]:
        found = list(self.always)
        for token in tokens_of(url):
            found += self.by_token.get(token, ())
        return sorted(found)

    def decide(self, url: str | None) -> tuple[str, str, Rule | None]:
        host, path = split(url)
        if url is None:
            return host, path, None
        for number in self.candidates(url):
            rule = self.rules[number]
            if self.expressions[number].match(host + path if rule.kind == "host" else url):
                # A URL without "://" has no host for a host rule to fit.
                if rule.kind == "pattern" or "://" in url:
                    return host, path, rule
        return host, path, None


def judge(
    pages: DataFrame, rules: Sequence[Rule], default: str = "allow", column: str = "url", keep: list[str] | None = None
) -> DataFrame:
    """``pages`` (or its columns ``keep``) with host, path, rule, pattern and verdict.

    ``rule`` is the text of the host rule that decided, ``pattern`` that of the
    pattern rule; at most one of them is not null.
    """
    if sum(len(r.text.encode()) + 32 for r in rules) > MAX_BYTES:
        raise ValueError(f"the rules have more than {MAX_BYTES} bytes")
    new = StructType.fromDDL(ADDED)
    names = [c for c in (pages.columns if keep is None else keep) if c not in new.fieldNames()]
    counts = token_counts(pages, rules, column)
    source = pages.select(*names, F.col(column).alias("_url"))
    schema = StructType([source.schema[c] for c in names] + list(new.fields))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for batch in batches:
            urls = batch.column("_url").dictionary_encode()  # each distinct URL of a batch is judged once
            found = []
            for url in urls.dictionary.to_pylist():
                host, path, rule = index.decide(url)
                of_host = rule is not None and rule.kind == "host"
                found.append((host, path, rule.text if of_host else None, None if of_host or rule is None else rule.text, rule.action if rule else default))
            found.append(("", "", None, None, default))  # of null
            at = urls.indices.fill_null(len(found) - 1)
            columns = [pa.array(c, pa.string()).take(at) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], schema.names)

    return source.mapInArrow(work, schema)
