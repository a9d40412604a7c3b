"""Variant spellings of names: merge-and-rematch resolution.

Each different string of a field is a record; records with the same words are one entity from the start. An entity's
profile unites the spellings of its records: words with and without marks, initials, given names, and the strings within
one edit. In each round an entity that is known only by a poorer form (without marks, with a typing error, with initials,
by given name and title) looks among the profiles for the one richer entity with its key, and merges where exactly one
has it. Merged profiles are richer and enter the next round; the rounds end when nothing merges any more.

Keys are aggregated before they are compared, so an entity with many records counts once, and a key that several
entities share merges nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Container

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.names import club_core, deletions, edits, fold, plain_name
from pitchlake.llm.wordsets import filter_bits
from pitchlake.session import materialize, release

# Words before a person's name, with their marks: without, several of them are surnames.
PERSON_TITLES = frozenset({"ông", "bà", "anh", "chị", "bầu", "hlv", "chủ tịch", "phó chủ tịch", "mr", "mrs", "ms", "coach", "thầy", "huấn luyện viên", "giám đốc", "tổng giám đốc", "president", "chairman", "manager", "doctor", "dr", "head coach", "boss"})
_NICKNAME = re.compile(r"[\"“”«»'‘’][^\"“”«»]*[\"“”«»'‘’]|\([^()]*\)")
_INITIAL = re.compile(r"\b(\w)\.\s*(?=\w)")

_RECORD = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("words", T.StringType()),
        T.StructField("folded", T.StringType()),
        T.StructField("marks", T.BooleanType()),
        T.StructField("lead", T.StringType()),
        T.StructField("tail", T.StringType()),
        T.StructField("tail_folded", T.StringType()),
    ]
)


def _marked(s: str) -> bool:
    return any(unicodedata.combining(c) for c in unicodedata.normalize("NFD", s)) or "đ" in s


def read_club(name: str) -> tuple:
    """(kind, words, folded, marks, lead, tail) of a club's spelling: its last two words, and b for a side marked B."""
    text = plain_name(name)
    kept = club_core(name).split()
    second = len(kept) > 2 and kept[-1] == "b"
    core = kept[-3:] if second else kept[-2:]
    words = text.split()
    folds = [fold(w) for w in words]
    out, at = [], len(words)
    for w in reversed(core):
        while at > 0 and folds[at - 1] != w:
            at -= 1
        if at == 0:
            return ("full", " ".join(core), " ".join(core), False, "", "")
        out.append(words[at - 1])
        at -= 1
    own = " ".join(reversed(out)) or text
    return ("full", own, fold(own), _marked(own), "", "")


def _person_words(name: str) -> list[str]:
    """Words of a person's spelling without titles and nicknames; what follows a comma comes first."""
    s = _NICKNAME.sub(" ", unicodedata.normalize("NFKC", name))
    parts = [p.strip() for p in s.split(",") if p.strip()]
    if len(parts) == 2:
        s = f"{parts[1]} {parts[0]}"
    words = plain_name(_INITIAL.sub(r"\1 ", s)).split()
    while words:
        n = next((n for n in (3, 2, 1) if len(words) - n >= 2 and " ".join(words[:n]) in PERSON_TITLES), 0)
        if n == 0:
            break
        words = words[n:]
    return words


def read_person(name: str, surnames: Container[str] = frozenset()) -> tuple:
    """(kind, words, folded, marks, lead, tail) of a person's spelling without titles and nicknames.

    kind is ``full``, ``initials`` (lead holds the initials, tail the words after them) or ``given`` (two words or fewer).
    The words of a full name are sorted, as parts of names are reordered; its lead (initials) and tail (the last two
    words) are read from the surname on, and are empty where no word or several could be it.
    """
    words = _person_words(name)
    if not words:
        return ("full", plain_name(name), fold(name), False, "", "")
    text = " ".join(words)
    marks = _marked(text)
    lead = [w for w in words if len(w) == 1]
    if lead and len(words) - len(lead) >= 2 and all(len(w) == 1 for w in words[: len(lead)]):
        return ("initials", text, fold(text), marks, fold(" ".join(lead)), " ".join(words[len(lead) :]))
    if len(words) <= 2:
        return ("given", text, fold(text), marks, "", text)
    at = [i for i, w in enumerate(words) if fold(w) in surnames]
    if at and at[0] != 0:
        words = words[at[0] :] + words[: at[0]] if len(at) == 1 else []
    elif not at:
        words = []
    start, end = (" ".join(fold(w)[0] for w in words[:-2]), " ".join(words[-2:])) if words else ("", "")
    full = text.split()
    return ("full", " ".join(sorted(full)), " ".join(sorted(fold(w) for w in full)), marks, start, end)


def _reader(surnames=None):
    """Records of persons with the filter of surnames (a broadcast variable), of clubs without one."""

    @F.pandas_udf(_RECORD)
    def read(names: pd.Series) -> pd.DataFrame:
        from pitchlake.llm import variants
        from pitchlake.llm.wordsets import WordFilter

        known = None if surnames is None else WordFilter(surnames.value)
        rows = [variants.read_club(n) if known is None else variants.read_person(n, known) for n in names]
        return pd.DataFrame([(*r, fold(r[5])) for r in rows], columns=["kind", "words", "folded", "marks", "lead", "tail", "tail_folded"])

    return read


@F.pandas_udf(T.ArrayType(T.StringType()))
def _full_words(names: pd.Series) -> pd.Series:
    """Folded words of names of three words or more without titles, nicknames and initials; null for others."""
    words = [_person_words(n) for n in names]
    return pd.Series([[fold(x) for x in w] if len(w) > 2 and all(len(x) > 1 for x in w) else None for w in words], dtype=object)


def surname_bits(people: DataFrame) -> bytes:
    """Filter of the words that begin names: of a word's places in full names the first is more than half, even at the lower end of the Wilson interval (95 %)."""
    placed = people.select(F.posexplode(_full_words("name")).alias("at", "word"))
    counts = placed.groupBy("word").agg(F.count_if(F.col("at") == 0).alias("first"), F.count("*").alias("n")).filter("first > 0")
    share, n, z = F.col("first") / F.col("n"), F.col("n"), 1.96
    lower = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return filter_bits(counts.filter(lower > 0.5).select("word"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _near(folded: pd.Series) -> pd.Series:
    """Keys that names share which differ by one edit in one word: of three or more words all but one with what is left of that one, else all letters but one.

    Names that merely have all other words in common share no key, so a frequent surname and middle name make no block.
    """
    out = []
    for f in folded:
        words = f.split()
        if len(words) > 2 and words[-1] != "b":
            out.append(sorted({f"{' '.join([*words[:i], *words[i + 1 :]])}|{d}" for i, w in enumerate(words) for d in deletions(w, 1)}))
        else:
            out.append(sorted(deletions("".join(words), 1)))
    return pd.Series(out)


_DIFFERENCE = T.StructType([T.StructField("edits", T.IntegerType()), T.StructField("marks", T.IntegerType()), T.StructField("odd", T.StringType()), T.StructField("usual", T.StringType())])


@F.pandas_udf(_DIFFERENCE)
def _difference(a: pd.Series, b: pd.Series, a_marked: pd.Series, b_marked: pd.Series) -> pd.DataFrame:
    """Edits between two folded names, whether their marks differ in the words they share, and the words that differ."""
    rows = []
    for x, y, xm, ym in zip(a, b, a_marked, b_marked):
        xs, ys = x.split(), y.split()
        left = [w for w in xs if w not in ys]
        right = [w for w in ys if w not in xs]
        n = edits("".join(xs), "".join(ys), 1)
        if len(left) == len(right) == 1 and len(xs) == len(ys):
            n = edits(left[0], right[0], 1)
        elif n > 0:
            n = 9
        if ("b" in xs) != ("b" in ys):
            n = 9
        other = 0
        if _marked(xm) and _marked(ym):
            shared_x = sorted(w for w in xm.split() if fold(w) in ys)
            shared_y = sorted(w for w in ym.split() if fold(w) in xs)
            other = int(shared_x != shared_y)
        rows.append((n, other, left[0] if len(left) == 1 else "", right[0] if len(right) == 1 else ""))
    return pd.DataFrame(rows, columns=["edits", "marks", "odd", "usual"])


#: A word is a typing error of another where it is this many times rarer, or where both are too rare to tell.
RARER = 8


def _only_one(keys: DataFrame, key: list[str]) -> DataFrame:
    """(key, target): keys that exactly one entity has."""
    return keys.groupBy(*key).agg(F.min("entity").alias("target"), F.max("entity").alias("other")).filter("target = other").drop("other")


def _one_target(links: DataFrame) -> DataFrame:
    """(entity, target): entities whose links lead to one target only."""
    return links.groupBy("entity").agg(F.min("target").alias("target"), F.max("target").alias("other")).filter("target = other").drop("other")


def near_spellings(full: DataFrame) -> DataFrame:
    """(field, words, t_words, close, usual, odd_n, usual_n, doubled, several): ordered pairs of spellings of full names that differ in one word by one edit.

    Computed once: the rounds only look up whose spellings these now are. Spellings meet by the keys of ``_near``, which few
    names share; word counts are over all fields, as a word of any of them is a word of the language.
    """
    spelled = full.groupBy("field", "words", "folded").agg(F.sum("n").alias("n"))
    words = spelled.select(F.explode(F.split("folded", " ")).alias("word"), "field", "folded").distinct().groupBy("word").agg(F.count("*").alias("n"))
    keyed = spelled.select("field", F.explode(_near("folded")).alias("key"), "words", "folded")
    pairs = keyed.join(keyed.select("field", "key", F.col("words").alias("t_words"), F.col("folded").alias("t_folded")), ["field", "key"]).filter("folded <> t_folded").drop("key").distinct()
    pairs = pairs.withColumn("d", _difference("folded", "t_folded", "words", "t_words")).filter("d.edits <= 1 AND d.marks = 0").select("*", "d.odd", "d.usual")
    pairs = pairs.join(words.select(F.col("word").alias("odd"), F.col("n").alias("odd_n")), "odd", "left").join(words.select(F.col("word").alias("usual"), F.col("n").alias("usual_n")), "usual", "left").fillna(0, ["odd_n", "usual_n"])
    doubled = F.regexp_replace("odd", r"(.)\1", "$1") == F.col("usual")
    several = F.size(F.split("folded", " ")) >= 3  # the other words alone tell who it is
    rarer = (F.col("odd") == "") | (F.col("odd_n") * RARER <= F.col("usual_n")) | ((F.col("odd_n") <= 1) & (F.col("usual_n") > F.col("odd_n"))) | doubled | (several & ~F.col("folded").endswith(" b"))
    return pairs.select("field", "words", "t_words", "odd_n", "usual_n", rarer.alias("rarer"))


def _marks(records: DataFrame, near: DataFrame) -> DataFrame:
    """Full names without marks: the one entity with marks that has these letters."""
    full = records.filter("kind = 'full'")
    marked = full.filter("marks").select("field", "folded", "entity").distinct()
    bare = full.groupBy("field", "entity").agg(F.max("marks").alias("marks"), F.min("folded").alias("folded")).filter("NOT marks").drop("marks")
    return bare.join(_only_one(marked, ["field", "folded"]), ["field", "folded"]).select("entity", "target")


def _typing(records: DataFrame, near: DataFrame) -> DataFrame:
    """Typing errors: each entity by its most frequent spelling, against all spellings of the others."""
    full = records.filter("kind = 'full'")
    size = full.groupBy("field", "entity").agg(F.count("*").alias("names"), F.sum("n").alias("rows"), F.max("marks").alias("any_marks"))
    spelled = full.groupBy("field", "entity", "words", "folded").agg(F.sum("n").alias("n"))
    common = spelled.groupBy("field", "entity", "folded").agg(F.sum("n").alias("n"), F.max("words").alias("words")).groupBy("field", "entity").agg(F.max(F.struct("n", "folded", "words")).alias("m"))
    weak = common.join(size, ["field", "entity"]).select("field", "entity", F.col("m.words").alias("words"), "any_marks", "rows", "names")
    strong = spelled.join(size, ["field", "entity"]).select("field", F.col("words").alias("t_words"), F.col("entity").alias("target"), F.col("any_marks").alias("t_marks"), F.col("rows").alias("t_rows"))
    pairs = near.join(weak, ["field", "words"]).join(strong, ["field", "t_words"]).filter("entity <> target")
    unmarked = ~F.col("any_marks") & F.col("t_marks") & (F.col("rows") <= F.col("t_rows"))
    better = F.struct("usual_n", "t_marks", "t_rows", "target") > F.struct("odd_n", "any_marks", "rows", "entity")
    alone = f"names = 1 OR rows * {RARER} <= t_rows"  # several dressings may be another club, unless they are rare beside the target
    pairs = pairs.filter(alone).filter(better | (unmarked & (F.col("usual_n") >= 2))).filter(F.col("rarer") | unmarked)
    return _one_target(pairs.select("entity", "target"))


def _short(records: DataFrame, near: DataFrame) -> DataFrame:
    """Names of three words: the one longer name with the first initial, the last two words and no word less."""
    named = records.filter("kind = 'full' AND tail <> ''").select("field", "entity", F.substring("lead", 1, 1).alias("first"), F.length(F.regexp_replace("lead", " ", "")).alias("size"), "tail", F.split("folded", " ").alias("all"))
    short = named.filter("size = 1").select("field", "entity", "first", "tail", "all")
    longer = named.filter("size > 1").select("field", "first", "tail", F.col("entity").alias("target"), F.col("all").alias("t_all")).distinct()
    return _one_target(short.join(longer, ["field", "first", "tail"]).filter("entity <> target AND size(array_except(all, t_all)) = 0").select("entity", "target"))


def _poor(records: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """Entities without any full name: the one entity with a full name that has the key, with marks or, written without, without."""
    poor = records.groupBy("field", "entity").agg(F.max((F.col("kind") == "full").cast("int")).alias("rich")).filter("rich = 0").drop("rich")
    asked = poor.join(records.filter(F.col("kind") == kind).select("field", "entity", "lead", "tail", "tail_folded", "marks"), ["field", "entity"])
    rich = records.filter("kind = 'full' AND tail <> ''")
    ways = []
    for marks, tail in ((True, "tail"), (False, "tail_folded")):
        key = ["field", *keep, tail]
        ways.append(asked.filter(F.col("marks") == marks).join(_only_one(rich.select(*key, "entity").distinct(), key), key).select("entity", "target"))
    return _one_target(ways[0].unionByName(ways[1]))


#: Rules in order; each takes the records with their present entities and the near spellings and gives (entity, target).
RULES = {"marks": _marks, "typing": _typing, "short": _short, "initials": lambda r, _: _poor(r, "initials", ["lead"]), "given": lambda r, _: _poor(r, "given", [])}


def settled(links: DataFrame) -> DataFrame:
    """Links (entity, target) that may merge at once: the target stays where it is.

    A link to an entity that moves itself waits for the next round; of two entities that link to each other the greater moves.
    """
    onward = links.select(F.col("entity").alias("target"), F.col("target").alias("onward"))
    return links.join(onward, "target", "left").filter("onward IS NULL OR (onward = entity AND entity > target)").select("entity", "target")


def resolve(names: DataFrame, persons: dict[str, bool]) -> DataFrame:
    """(field, name, entity): the entity of each different non-null string of each field.

    ``names`` has field and name, repeated as often as they occur; ``persons`` tells for each field whether it names
    persons or clubs. Null names are left out; an empty or blank one is an entity of its own. Fields aren't mixed.
    """
    counted = materialize(names.filter("name IS NOT NULL").groupBy("field", "name").agg(F.count("*").alias("n")), "p5-names")
    people = counted.filter(F.col("field").isin([f for f, p in persons.items() if p]))
    clubs = counted.filter(F.col("field").isin([f for f, p in persons.items() if not p]))
    surnames = names.sparkSession.sparkContext.broadcast(surname_bits(people))
    parts = people.withColumn("r", _reader(surnames)("name")).unionByName(clubs.withColumn("r", _reader()("name")))
    key = F.when(F.col("r.folded") == "", F.col("name")).otherwise(F.concat_ws("|", "r.kind", F.when(F.col("r.kind") == "initials", F.col("r.lead")).otherwise(F.lit("")), "r.words"))
    records, seed = None, 0
    keyed = materialize(parts.select("field", "name", "n", "r.*", key.alias("key")), "p5-keyed")
    while records is None:  # another seed should two keys have one hash
        records = keyed.withColumn("entity", F.xxhash64("field", "key", F.lit(seed)))
        if records.groupBy("entity").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("field").alias("f"), F.max("field").alias("g")).filter("a <> b OR f <> g").isEmpty():
            break
        records, seed = None, seed + 1
    records = materialize(records.drop("key"), "p5-records")
    near = materialize(near_spellings(records.filter("kind = 'full' AND folded <> ''")), "p5-near")
    merges, seen = 1, dict.fromkeys(RULES, 0)
    while any(n < merges for n in seen.values()):  # a rule runs again only after a merge
        for rule, links_of in RULES.items():
            if seen[rule] == merges:
                continue
            links = materialize(settled(links_of(records, near)), f"p5-links-{rule}")
            seen[rule] = merges
            if not links.isEmpty():
                merges += 1
                old, records = records, materialize(records.join(links, "entity", "left").withColumn("entity", F.coalesce("target", "entity")).drop("target"), "p5-records")
                release(old)
    return records.select("field", "name", "entity")


def linked_pairs(resolved: DataFrame) -> DataFrame:
    """(field, name_a, name_b): the pairs of different strings of one entity, name_a first by code point."""
    a = resolved.select("field", "entity", F.col("name").alias("name_a"))
    b = resolved.select("field", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["field", "entity"]).filter("name_a < name_b").select("field", "name_a", "name_b")
