"""Text and path functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of source code.
CODE_EXTENSIONS = (
    "rs py js ts tsx jsx go c h cpp cc hpp java rb sh bash zsh php swift kt scala lua pl r sql toml yaml yml json xml html css scss "
    "vue ex exs erl hs ml fs cs dart zig nim"
).split()

#: Directories out of scope at any depth, but for the store's own folder, which scope takes as a parameter.
ALWAYS_IGNORED = (".context", ".git", ".obsidian", ".trash")


def extension(path: Column) -> Column:
    """Lower-cased extension; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(path, r"(?s)[^/.][^/]*\.([^./]*)/*$|\.[^/]*\.([^./]*)$", 1))


def classify(path: Column, data: Column) -> Column:
    """binary, code or text, by bytes and then extension."""
    raw = data.cast("binary")
    binary = ~F.is_valid_utf8(raw.cast("string")) | F.contains(raw, F.lit(b"\x00"))
    return F.when(binary, "binary").when(extension(path).isin(*CODE_EXTENSIONS), "code").otherwise("text")


def glob_regex(glob: str) -> str:
    """A pattern of `*` (within a segment), `**` (across) and `?` (one character of a segment) as a regular expression."""
    out = []
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out.append({"**": r"[\s\S]*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    return "".join(out)


def ignore_rules(content: str) -> list[tuple[str, bool]]:
    """(regular expression, ignored) of each rule of an ignore file, in order."""
    rules = []
    for raw in content.splitlines():
        line = raw.rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        negate = line.startswith("!")
        line = line.removeprefix("!")
        anchored = line.startswith("/")
        line = line.removeprefix("/").removesuffix("/")
        # What a rule matches, it covers with everything below; a directory rule hits a plain file of that name too.
        rules.append((rf"^{'' if anchored else r'(?:[\s\S]*/)?'}{glob_regex(line)}(?:/[\s\S]*)?$", not negate))
    return rules


def ignored(path: Column, content: str, private: str = ".store") -> Column:
    """Is the path out of scope? The last rule that matches decides; some directories always are."""
    decided = F.lit(False)
    for pattern, verdict in ignore_rules(content):
        decided = F.when(path.rlike(pattern), F.lit(verdict)).otherwise(decided)
    always = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in (private, *ALWAYS_IGNORED)]))
    return always | decided


#: What the trimming of a line removes at both ends.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF\u000B]"


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    trimmed = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"{SPACE}+"))).cast("long")


def line_count(text: Column) -> Column:
    """Lines without trailing newlines; an empty text has none, one of newlines only has one."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n+$", ""), "\n", -1))).cast("long")


def has_frontmatter(text: Column) -> Column:
    """Does the text begin with a line `---` and hold another? Carriage returns and white space round a line do not count."""
    lines = F.split(F.translate(text, "\r", ""), "\n", -1)
    fence = lambda x: x.rlike(f"^{SPACE}*---{SPACE}*$")
    return fence(lines[0]) & F.exists(F.slice(lines, F.lit(2), F.size(lines)), fence)


LINK = r"\[(?:!\[[^\]]*\]\([^)]*\)|[^\]\[]*)\]\(([^)\s]+)[^)]*\)|!\[[^\]]*\]\(([^)\s]+)[^)]*\)"


def markdown_links(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, target) of the links and images of a text, in order; an image inside a link gives the link's target."""
    found = F.regexp_extract_all(F.col(text), F.lit(LINK), F.lit(0))
    rows = df.select(key, F.posexplode(found).alias("place", "link"))
    return rows.select(key, "place", F.regexp_extract("link", r"\(([^()\s]+)[^()]*\)$", 1).alias("target"))


#: The extensions that share another's language; any other extension is its own.
SAME_LANGUAGE = {"js": "ts tsx js jsx mjs cjs", "sh": "sh bash zsh", "yaml": "yml yaml", "css": "css scss"}


def lang_of(path: Column) -> Column:
    """The language of a path's extension (ASCII letters and digits after the last dot), `txt` without one."""
    end = F.lower(F.regexp_extract(path, r"(?s)\.([A-Za-z0-9]+)$", 1))
    names = F.create_map(*[F.lit(x) for name, ends in SAME_LANGUAGE.items() for end_ in ends.split() for x in (end_, name)])
    return F.when(end == "", "txt").otherwise(F.coalesce(names[end], end))
