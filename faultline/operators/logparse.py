"""Problem 5: semi-structured log lines to entries with time, severity and component.

Method: template mining by longest common subsequence.  Lines that state a
level are masked and counted by an ordinary aggregate; the distinct masked
heads become typed tokens; each partition clusters them into templates of
constants and slots; templates of all partitions are merged the same way; the
slots of each merged template are classified by type, which gives its layout:
an anchored pattern that names the time, level and component slots.  Lines
that open with a layout begin an entry.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.instants import clock_micros
from faultline.functions.logtokens import COMPONENT_KEYS, LEVEL, LEVEL_KEYS, MARK_TIME, MARKS, STRING, TIME, TIME_KEYS, WORD, clean_line, clock_seconds, key_name, severity, tokens

#: One token of any kind, and any number of tokens.
SLOT, GAP = "<*>", "<**>"
#: A line joins a template whose common subsequence covers this share of the constants of both.
SHARE = 0.5
#: A plain head ends at most so many symbols after its level, a head with a priority at most so many after its start; a long bracket counts as one of two words.
HEAD_SYMBOLS = 12
#: More distinct layouts than programs that log can have: an error, never a cut.
MOST_LAYOUTS = 20_000
_SLOTS = {SLOT, GAP}
_ANCHORS = {"<time>", "<level>", "<mark>", "<strtime>", "<strlevel>"}


def _is_anchor(symbol: str) -> bool:
    return symbol in _ANCHORS or symbol.endswith(("=", '":'))


def anchors(symbols: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """The typed skeleton: the head's shape, then times, levels and keys in order.  Only equal skeletons are merged.

    The head runs to one symbol past the first level, or over the ten symbols
    that follow a priority mark; its words count as one type, but for a word
    right before the level: it names the program.
    """
    if tuple(symbols[:3]) == ("<", "<num>", ">"):
        stop = 10
    else:
        stop = next((i + 2 for i, s in enumerate(symbols) if s == "<level>"), 1)
    head = ["w" if _is_word(s) and (i or stop != 3) else s for i, s in enumerate(symbols[:stop])]
    return (*head, *(s for s in symbols[stop:] if _is_anchor(s)))


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence of constants."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] and x not in _SLOTS else max(below[j], row[j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j] and a[i] not in _SLOTS:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def join_templates(a: list[str], b: list[str], pairs: list[tuple[int, int]]) -> list[str]:
    """Constants in common; between them one slot a token where both have as many, else one gap."""
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        if GAP in a[i:x] or GAP in b[j:y] or x - i != y - j:
            out.append(GAP)
        else:
            out.extend([SLOT] * (x - i))
        if x < len(a):
            out.append(a[x])
        i, j = x + 1, y + 1
    return out


class Miner:
    """Online clustering of token sequences into templates."""

    def __init__(self, share: float = SHARE) -> None:
        self.share, self.by_anchors, self.seen = share, {}, {}

    def add(self, symbols: list[str], count: int = 1) -> None:
        key = tuple(symbols)
        if (at := self.seen.get(key)) is not None:
            at[1] += count
            return
        group = self.by_anchors.setdefault(anchors(symbols), [])
        line = "\0".join(symbols) + "\0"
        hit = next((t for t in group if t[2].fullmatch(line)), None)
        if hit is None:
            bag, best, best_pairs = set(symbols) - _SLOTS, None, []
            constants = sum(s not in _SLOTS for s in symbols)
            for t in group:
                if len(bag.intersection(t[0])) * 2 >= len(bag) * self.share:
                    pairs = common_subsequence(t[0], symbols)
                    if len(pairs) >= self.share * max(constants, sum(s not in _SLOTS for s in t[0])) and len(pairs) > len(best_pairs):
                        best, best_pairs = t, pairs
            if best is None:
                hit = [list(symbols), 0, None]
                group.append(hit)
            else:
                hit = best
                hit[0] = join_templates(hit[0], symbols, best_pairs)
            hit[2] = re.compile("".join("(?:[^\0]*\0)*?" if s == GAP else "[^\0]*\0" if s == SLOT else re.escape(s + "\0") for s in hit[0]))
        hit[1] += count
        if len(self.seen) < 200_000:
            self.seen[key] = hit

    def templates(self) -> Iterator[tuple[list[str], int]]:
        for group in self.by_anchors.values():
            for symbols, count, _ in group:
                yield symbols, count


def _special_kind(name: str) -> str | None:
    return next((k for k, known in (("level", LEVEL_KEYS), ("time", TIME_KEYS), ("component", COMPONENT_KEYS)) if name in known), None)


def essentials(symbols: list[str]) -> list[str] | None:
    """What a line's layout can depend on, in one pass over all its symbols; None if it states no level.

    Of keys and values: the opening, and each key of a level, time or component
    with its value, wherever it stands; gaps between.  Of other lines: all up
    to the first level and the symbols next to it.
    """
    if any(s.endswith(("=", '":')) and key_name(s) in LEVEL_KEYS for s in symbols):
        out: list[str] = []
        for i, s in enumerate(symbols):
            if (s.endswith(("=", '":')) and (_special_kind(key_name(s)) or s in _TEXT_KEYS)) or (i == 0 and s == "{"):
                out.append(s)
            elif out and out[-1] != GAP and not (i and symbols[i - 1] == out[-1] and out[-1] != "{"):
                out.append(GAP)
            elif out and out[-1] != GAP:
                out.append(s if s.startswith("<") else SLOT)
        return out
    if symbols[:3] == ["<", "<num>", ">"]:
        stop = HEAD_SYMBOLS
    elif (level := next((i for i, s in enumerate(symbols) if s in ("<level>", "<mark>")), None)) is None:
        return None
    else:
        stop = level + HEAD_SYMBOLS
    return symbols[:stop] if len(symbols) <= stop else [*symbols[:stop], GAP]


_LEVEL_WORD = rf"(?<![\w./\-]){LEVEL}(?![\w/\-]|\.\w)!?"
_LEVEL_KEY = rf'(?i:"(?:{"|".join(re.escape(k) for k in sorted(LEVEL_KEYS))})"\s*:|(?<!\S)(?:{"|".join(re.escape(k) for k in sorted(LEVEL_KEYS))})=)'
_MARKED = rf"[{''.join(MARKS)}]{MARK_TIME}(?![\d:])"
_NAMES_OF_DAYS = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: A plain head has at most so many words before its level; those of a long bracket count as two.
HEAD_WORDS = 12
#: Words, numbers and signs in Java's syntax, possessive, so that long texts need no stack.
_WORDS = r"[\p{L}\p{M}\p{N}_$]++(?:[.\-/$@][\p{L}\p{M}\p{N}_$]++)*+"
#: What makes at least one symbol: a time, a string, a word or number, a sign.
_UNIT = rf'(?:[\s\p{{Z}}]*+(?:{TIME}|"(?:[^"\\]|\\.)*+"|{_WORDS}|[^\s\p{{Z}}]))'
#: Enough of them for the symbols of a head: a key with its sign, or a level with its mark, is two units and may be one symbol.
_HEAD_UNITS = rf"^{_UNIT}{{0,{2 * HEAD_SYMBOLS + 2}}}"
#: A bracket of four or more words or signs and no time, such as the name of a thread.
_LONG_BRACKET = rf"\[(?![^\[\]]*{TIME})(?>[\s\p{{Z}}]*+(?:{_WORDS}|[^\s\p{{Z}}\[\]])){{4}}[^\[\]]*\]"


_OUTER = " \t\r\n\v\f\x1c\x1d\x1e\x1f\x85\u00a0\ufeff"


def head_shapes(lines: DataFrame, line: str) -> DataFrame:
    """(shape): each line's head with its variable parts masked; lines that state no level, so that they can open no entry, are left out.

    Colours and outer blanks are dropped and digits become 0.  Of keys and
    values, values become one letter unless they are a level, and a message is
    left out.  Of other lines, the words after the level become one letter, a
    long bracket becomes one of two words, and what follows the symbols that
    ``essentials`` takes is left out: symbols are counted, never characters, so
    names of hosts or threads may be of any length.  Lines of one program then
    share few shapes, whatever they say.  Costly columns stand in projections
    of their own, so each is computed once, and the last one is a generator, so
    that no filter copies them.
    """
    c = F.col
    bare = F.when(F.contains(line, F.lit("\x1b")), F.regexp_replace(line, r"\x1b\[[0-9;?]*[A-Za-z]|\x1b[()][A-Z0-9]", "")).otherwise(c(line))
    df = lines.select(F.translate(F.btrim(bare, F.lit(_OUTER)), "123456789", "000000000").alias("_plain"))
    df = df.withColumns({"_first": F.substring("_plain", 1, 1), "_at": F.regexp_instr("_plain", F.lit(_LEVEL_WORD))})
    df = df.select(
        "_plain", "_at",
        F.when((c("_first") == "<") & c("_plain").rlike(r"^<\d{1,3}>"), "priority").when(c("_first").isin(list(MARKS)) & c("_plain").rlike("^" + _MARKED), "mark")
        .when(((c("_first") == "{") | c("_plain").rlike(r"^[A-Za-z_@][\w.@\-]*=\S")) & c("_plain").rlike(_LEVEL_KEY), "keyed").when(c("_at") > 0, "plain").alias("_kind"),
    )
    df = df.withColumns({"_before": F.substr("_plain", F.lit(1), c("_at") - 1), "_level": F.regexp_extract(F.substr("_plain", c("_at"), F.lit(14)), rf"^{LEVEL}!?", 0)})
    mask = lambda x: F.regexp_replace(x, r"(?<!0)[\p{L}_$]+", "a")
    mask_but_times = lambda x: F.regexp_replace(x, rf"(?<![0\p{{L}}_$])(?!{_NAMES_OF_DAYS}\b)[\p{{L}}_$]+", "a")
    values = F.regexp_replace("_plain", rf'([:=]\s*)"(?!{LEVEL}"|{TIME}")(?:[^"\\]|\\.)*"', '$1"a"')
    values = F.regexp_replace(values, rf'([:=]\s*)(?!{LEVEL}(?![^\s,}}])|{TIME})(?:[^\s",}}\[{{0][^\s",}}]*)', "$1a")
    head = lambda x: F.regexp_extract(x, _HEAD_UNITS, 0)
    rest = F.substr("_plain", c("_at") + F.length("_level"))
    after = head(F.when(rest.rlike(rf"^[^\[\]]*{_LONG_BRACKET}"), F.regexp_replace(rest, rf"^([^\[\]]*){_LONG_BRACKET}", "$1[a a]")).otherwise(rest))
    words = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"[^\W\d_][\w.\-]*"), F.lit(0)))
    short = F.regexp_replace("_before", _LONG_BRACKET, "[a a]")
    shape = (
        F.when(c("_kind") == "keyed", values)
        .when(c("_kind") == "priority", mask_but_times(head(c("_plain"))))
        .when(c("_kind") == "mark", F.regexp_extract("_plain", "^" + _MARKED, 0))
        .when(c("_kind").isNull(), F.lit(None).cast("string"))
        .when(c("_before") == "", F.concat(c("_level"), mask_but_times(after)))
        .when((F.length("_before") < 24) | (words(c("_before")) <= HEAD_WORDS), F.concat(c("_before"), c("_level"), mask(after)))
        .when(c("_before").contains("[") & (words(short) <= HEAD_WORDS), F.concat(short, c("_level"), mask(after)))
    )
    return df.select(F.explode(F.filter(F.array(shape), lambda x: x.isNotNull())).alias("shape"))


#: A word that ``head_shapes`` has masked.
_MASKED = re.compile(r"a(?:[.\-/$@]a)*")


def _mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    miner = Miner()
    for batch in batches:
        for shape, n in zip(batch["shape"], batch["n"], strict=True):
            if (symbols := essentials(tokens(shape))) is not None:
                miner.add([SLOT if _MASKED.fullmatch(s) else s for s in symbols], n)
    rows = [(json.dumps(anchors(s)), json.dumps(s), n) for s, n in miner.templates()]
    yield pd.DataFrame(rows, columns=["anchors", "template", "n"])


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    miner = Miner()
    for template, n in frame.sort_values(["n", "template"], ascending=[False, True])[["template", "n"]].itertuples(index=False):
        miner.add(json.loads(template), n)
    return pd.DataFrame([(frame["anchors"].iloc[0], json.dumps(s), n) for s, n in miner.templates()], columns=["anchors", "template", "n"])


def mine_templates(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows (anchors, template, n): merged templates of all lines that state a level; templates and anchors are JSON arrays of symbols.

    NULL and blank lines are skipped.  Lines are masked and counted on the JVM,
    with a partial count before the shuffle, so Python sees each distinct shape
    of a head once.  Templates are merged as a tree: per partition of the
    shapes, then equal ones by an aggregate, then per typed skeleton.  Skeletons
    without a level were dropped before, and messages are masked, so a group
    grows with the variety of layouts, not with the data.
    """
    shapes = head_shapes(lines, line).groupBy("shape").agg(F.count("*").alias("n"))
    local = shapes.mapInPandas(_mine, "anchors string, template string, n bigint")
    equal = local.groupBy("anchors", "template").agg(F.sum("n").alias("n"))
    return equal.groupBy("anchors").applyInPandas(_merge, "anchors string, template string, n bigint")


_FRAGMENTS = {"<num>": r"\d+(?:\.\d+)?", "<str>": STRING, "<class>": r"[^\s:\]]+", "<strtime>": f'"{TIME}"', "<strlevel>": f'"{LEVEL}"', "<time>": TIME, "<level>": LEVEL + "!?"}


def _is_word(symbol: str) -> bool:
    return symbol in (SLOT, "<class>") or re.fullmatch(WORD, symbol) is not None


#: Any value of a key, brackets nested twice, and any number of keys with their values.
_IN_BRACKETS = rf'\[(?:{STRING}|[^\[\]"]|\[(?:{STRING}|[^\[\]"])*\])*\]|\{{(?:{STRING}|[^{{}}"]|\{{(?:{STRING}|[^{{}}"])*\}})*\}}'
_ANY_PAIR = rf'(?:{STRING}\s*:\s*(?:{STRING}|{_IN_BRACKETS}|[^\s",{{}}\[\]]+)\s*,\s*)*?'
_ANY_ASSIGNMENT = rf'(?:(?!(?:msg|message)=)[A-Za-z_@][\w.@\-]*=(?:{STRING}(?!\S)|\S*)\s+)*?'
_TEXT_KEYS = {"msg=", "message="}


def _keyed_layout(symbols: list[str]) -> str | None:
    """Pattern of a layout of keys and values, None if no key states a level.

    Only the keys of level, time and component are named, in their order; any
    others may stand between.  So layouts are made of a closed set of keys.
    """
    json_like = any(s.endswith('":') for s in symbols)
    between = _ANY_PAIR if json_like else _ANY_ASSIGNMENT
    out, taken = [], set()
    for i, s in enumerate(symbols):
        if s in _TEXT_KEYS:
            break
        if not s.endswith(("=", '":')):
            continue
        name = key_name(s)
        value = symbols[i + 1] if i + 1 < len(symbols) else SLOT
        kind = _special_kind(name)
        if kind is None or kind in taken or (kind == "level" and value not in ("<level>", "<strlevel>", "<num>", SLOT)):
            continue
        key = rf'"(?i:{re.escape(name)})"\s*:\s*' if json_like else rf"(?i:{re.escape(name)})="
        if kind == "level":
            body = rf'(?:"(?P<level>{LEVEL})"|(?P<number>\d+))' if json_like else rf'"?(?:(?P<level>{LEVEL})|(?P<number>\d+))"?(?!\S)'
        elif kind == "time":
            body = rf'"?(?P<time>{TIME}|\d{{10,19}})"?'
        else:
            body = r'(?:"(?P<component>(?:[^"\\]|\\.)*)"|(?P<bare>[^\s",}]+))'
        taken.add(kind)
        out.append(between + key + body)
    if "level" not in taken:
        return None
    return ("^\\{\\s*" if json_like else "^") + (r"\s*,\s*" if json_like else r"\s+").join(out)


def _plain_layout(symbols: list[str]) -> str | None:
    """Pattern of a layout by position, None if its head states no level."""
    n = len(symbols)
    if symbols[:1] == ["<mark>"]:
        return rf"^(?P<level>[{''.join(MARKS)}])(?P<time>{MARK_TIME})\s+\d+\s+[^\s\]]+\]"
    at = lambda i: symbols[i] if 0 <= i < n else ""
    priority = symbols[:3] == ["<", "<num>", ">"]
    level = 1 if priority else next((i for i, s in enumerate(symbols) if s == "<level>"), None)
    time = next((i for i, s in enumerate(symbols[: 6 if priority else n]) if s == "<time>"), None)
    if GAP in symbols[: (level or 0) + 1]:
        return None
    if level is None:
        return None
    if time is not None and time > level and not (time <= level + 2 or priority):
        time = None
    component, last = None, level
    if priority:
        if time is None:
            return None
        # <n>version time host program process
        component = time + 2 if _is_word(at(time + 1)) and _is_word(at(time + 2)) else None
        last = max(time, component or 0)
    elif level == 0:
        if time == 1:
            last = 1
            if at(2) == "[" and _is_word(at(3)) and at(4) == "]":
                component, last = (3, 4) if at(5) != "<class>" else (5, 5)
        elif at(1) != ":":
            return None
        else:
            last = 1
    elif time is not None and time < level:
        before = symbols[time + 1 : level]
        words = [i for i in range(time + 1, level) if _is_word(symbols[i])]
        if _only_brackets(before):
            return _bracketed_layout(symbols, time, level)
        if len(words) > 3:
            return None
        if at(level - 1) == ":" and _is_word(at(level - 2)) and at(level - 3) == "[":
            component, last = level - 2, level  # [module:level]
        elif "[" in before and at(level - 1) == ":":
            component = next((i for i in words if at(i + 1) == "["), None)  # program[process]: level:
            last = level
        elif len(words) == 1 and at(words[0] + 1) == at(words[0] - 1):
            component = words[0]  # time - component - level -
        elif words:
            return None
        elif at(level + 1) == "|" and _is_word(at(level + 2)) and at(level + 3) == "|":
            component, last = level + 2, level + 3
        else:
            # time level process --- [thread] logger : , or time *level* [thread] logger
            closing = next((i for i in range(level + 1, min(n, level + 12)) if symbols[i] == "]"), None)
            if closing is not None and (at(closing + 1) == "<class>" or at(closing + 2) == ":") and _is_word(at(closing + 1)):
                component = last = closing + 1
            elif closing is not None and _is_word(at(closing - 1)) and at(closing - 2) == "[":
                component, last = closing - 1, closing
    elif at(level - 1) == "[" and at(level + 1) == "]" and level == 1:
        last = 2
    elif level == 1 and re.fullmatch(WORD, symbols[0]):
        component = 0  # program level message
    else:
        return None
    out, inside = [], set()
    if time is not None and time < level < last == component and at(last - 1) == "]":  # a bracket of several words between level and component holds any
        opening = max((i for i in range(level + 1, last - 1) if symbols[i] == "["), default=last)
        inside = set(range(opening, last)) if last - opening > 3 or GAP in symbols[opening:last] else set()
    for i, s in enumerate(symbols[: last + 1]):
        if i in inside:
            if i - 1 not in inside:
                out.append(r"\[[^\[\]]*\]")
        elif i == level:
            out.append(r"(?P<number>\d{1,3})" if priority else rf"(?P<level>{LEVEL})!?")
        elif i == time:
            out.append(f"(?P<time>{TIME})")
        elif i == component:
            out.append(f"(?P<component>{re.escape(s)})" if i == 0 else r"(?P<component>[^\s\[\]|:]+)")
        elif s in _FRAGMENTS:
            out.append(_FRAGMENTS[s])
        elif _is_word(s):
            out.append(r"[^\s\[\]]+")
        else:
            out.append(re.escape(s))
    end = r"(?![\w/\-])" if last == level else r"(?!\S)" if _is_word(symbols[last]) and last != component else ""
    return "^" + r"\s*".join(out) + end


def _only_brackets(before: list[str]) -> bool:
    """Whether all words between time and level stand in square brackets, of which there is at least one pair with words, and the level outside."""
    depth, found = 0, False
    for s in before:
        depth += (s == "[") - (s == "]")
        if _is_word(s) or s == GAP:
            if depth != 1 or s == GAP:
                return False
            found = True
    return found and depth == 0


def _bracketed_layout(symbols: list[str], time: int, level: int) -> str:
    """Layout of a time, bracketed fields such as a thread, a level, and the logger that a dash or colon parts from the message."""
    at = lambda i: symbols[i] if i < len(symbols) else ""
    named = _is_word(at(level + 1)) and at(level + 2) in ("-", ":") or at(level + 1) == "<class>"
    opening = "".join(re.escape(s) + r"\s*" for s in symbols[:time])
    head = rf"^{opening}(?P<time>{TIME})[^\w\[]*(?:\[[^\]]*\][^\w\[]*)+(?P<level>{LEVEL})!?"
    return head + (r"\s+(?P<component>[^\s\[\]|:]+)\s*(?:[-:](?!\S)|(?=\s))" if named else r"(?![\w/\-])")


def layout_of(template: list[str]) -> str | None:
    """The anchored pattern of a template's head with groups time, level or number, component or bare; None if it is no entry head."""
    if any(s.endswith(("=", '":')) and key_name(s) in LEVEL_KEYS for s in template):
        return _keyed_layout(template)
    return _plain_layout(template)


def _rank(pattern: str) -> tuple[int, int, str]:
    return (-sum(f"(?P<{g}>" in pattern for g in ("time", "component", "level", "number")), -len(pattern), pattern)


def layouts(templates: DataFrame) -> list[str]:
    """Distinct layouts of mined templates, the most telling first.

    Action.  Layouts are made of a closed set of typed symbols and keys, and of
    the names of programs that write theirs right before the level, so their
    number follows the programs that log, not the amount of logs; more than
    ``MOST_LAYOUTS`` are an error, never cut.
    """

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {p for t in batch["template"] if (p := layout_of(json.loads(t)))}
            yield pd.DataFrame([(p,) for p in sorted(found)], columns=["layout"])

    found = [r[0] for r in templates.select("template").mapInPandas(classify, "layout string").distinct().limit(MOST_LAYOUTS + 1).collect()]
    if len(found) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} layouts: these are no program logs")
    return sorted(found, key=_rank)


def _openings(pattern: str) -> str | None:
    """Characters a layout can begin with, None for any: an escaped sign, or those of a time or of a level."""
    rest = pattern.removeprefix("^")
    if rest[:1] == "\\" and not rest[1].isalnum():
        return rest[1]
    if rest[:1] in tuple("!\"%',/:;<=>@`"):
        return rest[0]
    if rest.startswith("(?P<time>"):
        return "0123456789MTWFSJAOND"
    return None


def parse_entries(logs: DataFrame, log_id: str, fields: dict[str, str], exported_at: str) -> DataFrame:
    """Rows (log_id, field_name, start_pos, n_lines, utc_seconds, severity, component, message) for each entry.

    ``fields`` maps column names to 'lines' (an array of lines) or 'text' (one
    string, lines parted by a newline).  Lines before the first entry belong to
    none; NULL or blank lines continue the entry they follow; NULL or empty
    fields have no entries; repeated logs give repeated entries.  The message
    is the rest of the opening line and the lines that continue it.

    Action: mines the templates of all lines first (one pass), then declares
    the parsing pass.
    """
    lists = {f: F.col(f) if kind == "lines" else F.split(F.col(f), "\n") for f, kind in fields.items()}
    lines = logs.select(F.explode(F.flatten(F.array(*[F.coalesce(x.cast("array<string>"), F.array().cast("array<string>")) for x in lists.values()]))).alias("line"))
    found = layouts(mine_templates(lines))
    schema = "log_id string, field_name string, start_pos bigint, n_lines bigint, utc_seconds bigint, severity string, component string, message string"
    names = list(lists)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [(re.compile(p), _openings(p)) for p in found]
        by_first: dict[str, list[re.Pattern]] = {}

        def choices(first: str) -> list[re.Pattern]:
            if (known := by_first.get(first)) is None:
                known = by_first[first] = [p for p, openings in patterns if (first.isalnum() or first == "_" if openings is None else first in openings)]
            return known

        for batch in batches:
            rows = []
            for f, name in enumerate(names):
                for key, exported, texts in zip(batch["log_id"], batch["us"], batch[f"_f{f}"], strict=True):
                    if texts is None:
                        continue
                    exported = None if pd.isna(exported) else int(exported)
                    opened = None
                    for pos, raw in enumerate(texts):
                        text = clean_line(raw) if raw else ""
                        head = next((m for p in choices(text[0]) if (m := p.match(text))), None) if text else None
                        got = head.groupdict() if head else {}
                        level = severity(got.get("level"), got.get("number")) if head else None
                        if level is not None:
                            opened = [key, name, pos, 1, clock_seconds(got.get("time"), exported), level, got.get("component") or got.get("bare") or "", text[head.end() :].strip()]
                            rows.append(opened)
                        elif opened:
                            opened[3] += 1
                            opened[7] += "\n" + (raw or "")
            yield pd.DataFrame(rows, columns=["log_id", "field_name", "start_pos", "n_lines", "utc_seconds", "severity", "component", "message"])

    columns = [F.col(log_id).cast("string").alias("log_id"), clock_micros(logs, exported_at).alias("us"), *[x.cast("array<string>").alias(f"_f{i}") for i, x in enumerate(lists.values())]]
    return logs.select(*columns).mapInPandas(parse, schema)
