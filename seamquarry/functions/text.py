"""Column functions on source text: lines, hashes, sizes, terms, normal forms. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and str.strip see it, spelt out so that every regex engine agrees.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters as a string, for trimming.
SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Words that carry no meaning as search terms.
STOP_TERMS = "this that with from line file rule finding valid invalid code runtime check checks called function obsolete recommended later array length instead variable".split()
# Characters per token by model family, the first marker that a model's name holds decides.
FAMILY_RATIOS = [
    (["llama-3", "llama3", "meta.llama3"], 3.9),
    (["llama-2", "llama2", "meta.llama2", "codellama"], 3.2),
    (["llama"], 3.9),
    (["mixtral", "mistral-7b", "mistral:7b"], 3.2),
    (["mistral"], 3.9),
    (["qwen"], 4.0),
    (["deepseek"], 4.0),
    (["gemma", "gemini"], 4.0),
    (["phi-3", "phi3"], 3.5),
    (["phi"], 4.0),
    (["command", "cohere"], 4.0),
    (["titan", "amazon."], 4.0),
]
# Sensitive external functions by the kind of sink they are.
SINK_CALLS = {
    "buffer_overflow": "memcpy memmove strcpy strncpy strcat gets",
    "out_of_bounds": "strlen strnlen",
    "format_string": "sprintf vsprintf snprintf vsnprintf printf fprintf vprintf vfprintf",
    "command_injection": "system popen execl execle execlp execv execve execvp",
    "path_traversal": "fopen open stat lstat access unlink rename",
    "integer_overflow": "malloc calloc realloc kmalloc kcalloc krealloc",
    "use_after_free": "free kfree vfree",
    "other": "close ioctl scanf sscanf fscanf",
}
# Rank of each severity.
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Unknown": 0}


def unix_lines(text: Column) -> Column:
    """CR LF and lone CR become LF; null stays null."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines_of(text: Column) -> Column:
    """The lines, without an empty last one after a final line end. A null or empty text has none."""
    inner = F.regexp_replace(unix_lines(text), r"\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, "\n", -1))


def fold_space(text: Column) -> Column:
    """Runs of white space become one space, none at the ends. Lone spaces, by far the most, are never matched."""
    odd = SPACE.replace(r"[\s", r"[\t\n\f\r")
    return F.trim(F.regexp_replace(text, f" *{odd}{SPACE}*|  +", " "))


def stripped(text: Column) -> Column:
    """Without white space at the ends; null counts as empty."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def content_hash(text: Column) -> Column:
    """16 hex digits that don't change with white space. Null stays null."""
    return F.left(F.sha2(fold_space(text), 256), F.lit(16))


def location_fingerprint(file: Column, line: Column, rule: Column) -> Column:
    """SHA-256 of file:line:rule; null parts count as empty."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in (file, line, rule))), 256)


def token_estimate(text: Column, ratio: Column | float) -> Column:
    """Characters over ratio, rounded up, at least 1; 0 for a null or empty text."""
    ratio = F.lit(ratio) if isinstance(ratio, (int, float)) else ratio
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / ratio))).cast("bigint")


def family_ratio(model: Column, default: float = 4.0) -> Column:
    """Characters per token of a model, by its name; unknown and null names get the default."""
    name = F.lower(F.coalesce(model, F.lit("")))
    out = None
    for markers, ratio in FAMILY_RATIOS:
        hit = name.contains(markers[0])
        for m in markers[1:]:
            hit = hit | name.contains(m)
        out = F.when(hit, ratio) if out is None else out.when(hit, ratio)
    return out.otherwise(default)


def terms(text: Column, limit: int = 6) -> Column:
    """The first distinct words of four or more characters that aren't stop words, in order; case is kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), 0)
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~F.lower(x).isin(STOP_TERMS))), 1, limit)


def call_names(text: Column, limit: int = 10) -> Column:
    """The first distinct names that stand before an opening parenthesis, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)), 1, limit)


def symbols(code: Column, prose: Column, limit: int = 8, longest: int = 64) -> Column:
    """The first distinct names to look code up by: what it calls, its other names, then the prose's words; without stop words and names that are too long."""
    every = lambda t, p, g: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), g)
    found = F.concat(every(code, r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1), every(code, "[A-Za-z_][A-Za-z0-9_]*", 0), every(prose, "[A-Za-z_][A-Za-z0-9_]{3,}", 0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: (F.length(x) <= longest) & ~F.lower(x).isin(STOP_TERMS))), 1, limit)


def query_terms(text: Column) -> Column:
    """Lower-case search terms."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), 0), F.lower)


def sink_type(value: Column) -> Column:
    """A sink kind as a lower-case name of letters, digits and single underscores; `other` where nothing is left."""
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("other")))), "[^a-z0-9_]+", "_"), "_+", "_")
    v = F.regexp_replace(v, "^_|_$", "")
    return F.when(v == "", "other").otherwise(v)


def severity_title(value: Column) -> Column:
    """A severity in title case if it is a known one, else as written, stripped; Unknown for null or blank."""
    v = fold_space(F.coalesce(value, F.lit("")))
    known = [k for k in SEVERITY_RANK if k != "Unknown"]
    out = F.when(v == "", "Unknown")
    for k in known:
        out = out.when(F.upper(v) == k.upper(), k)
    return out.otherwise(F.trim(value))


def severity_rank(title: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv))
    return F.coalesce(F.element_at(m, title), F.lit(0))


def repo_path(path: Column) -> Column:
    """A repository-relative path: forward slashes, no leading `./`, no doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./+)+", ""), "/{2,}", "/")


def top_folder(path: Column) -> Column:
    """The text before the first slash; the whole path where there is none."""
    return F.substring_index(F.coalesce(path, F.lit("Unknown")), "/", 1)


def numbered(lines: Column, first: Column | int = 1) -> Column:
    """The lines under each other, each with its right-aligned number and a colon."""
    first = F.lit(first) if isinstance(first, int) else first
    width = F.length((first + F.size(lines) - 1).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((first + i).cast("string"), width, " "), F.lit(": "), x)), "\n")


def window_lines(lines: Column, line: Column, radius: int) -> Column:
    """The numbered lines around one, cut at the text's ends; empty for an empty text."""
    n = F.size(lines)
    a = F.greatest(F.lit(1), F.least(F.greatest(line, F.lit(1)) - radius, n))
    b = F.greatest(a, F.least(F.greatest(line, F.lit(1)) + radius, n))
    cut = F.slice(lines, a, b - a + 1)
    width = F.length(b.cast("string"))
    shown = F.array_join(F.transform(cut, lambda x, i: F.concat(F.lpad((a + i).cast("string"), width, " "), F.lit(": "), x)), "\n")
    return F.when(n == 0, "").otherwise(shown)


def byte_slice(text: Column, start: Column | int, end: Column | int) -> Column:
    """The text of a UTF-8 byte span, clamped; a cut character decodes to U+FFFD."""
    raw = F.encode(text, "UTF-8")
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    n = F.octet_length(text)
    a = F.greatest(F.lit(0), F.least(start, n))
    b = F.greatest(a, F.least(end, n))
    return F.decode(F.substring(raw, a + 1, b - a), "UTF-8")


def clipped(text: Column, max_lines: int, max_chars: int) -> Column:
    """At most so many lines and characters, with a mark after each cut."""
    mark = F.lit("\n...[truncated]")
    ls = lines_of(text)
    a = F.when(F.size(ls) > max_lines, F.concat(F.array_join(F.slice(ls, 1, max_lines), "\n"), mark)).otherwise(F.coalesce(text, F.lit("")))
    return F.when(F.length(a) > max_chars, F.concat(F.substring(a, 1, max_chars), mark)).otherwise(a)


def glob_regex(pattern: str) -> str:
    """A shell pattern over whole paths as a regular expression: * and ? stay within a folder, ** crosses folders."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])), i + 1
    return f"^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ordered ignore rules leave a path out: the last rule that matches it or a folder above it decides, ! takes back."""
    out = F.lit(False)
    for raw in patterns:
        p = raw.rstrip()
        if not p or p.startswith("#"):
            continue
        keep, p = p.startswith("!"), p.lstrip("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.lstrip("/")
        body = glob_regex(p)[1:-1]
        rx = ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")
        out = F.when(F.coalesce(path, F.lit("")).rlike(rx), not keep).otherwise(out)
    return out


def multiset_hash(hexes: Column) -> Column:
    """An aggregate of SHA-256 values in hex: a hash of all of them with their repeats, in no order. Four sums of 60 bits each
    make it, so they are partial before the shuffle and no row ever lists what is hashed."""
    part = lambda i: F.sum(F.conv(F.substring(hexes, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(" ", *map(part, range(4))), 256)
