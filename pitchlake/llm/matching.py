"""Matching of records without a common key by a cascade of deterministic rules.

A rule joins exactly on one form of the name and one set of further attributes; rules run from the strongest to the
weakest in passes, and what a pass resolves is taken out by an anti join before the next. A key that several entities
share decides nothing. The confidence of a match is its rule's precision on records whose entity is known. Each of them is
tried against every rule, whatever an earlier pass would have made of it, under its own name and under the forms that people
derive from it (short, with initials, given name, one word open), since labelled names are mostly written in full. Counts are
smoothed by two cases of the precision of similar rules, and those by one right and one wrong case. A rule gives no matches
only where its trials show that it is bad.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.lookalikes import alphabet
from pitchlake.llm.names import bare, club_core, edits, fold, plain_name
from pitchlake.session import materialize

# Words before a name that aren't part of it, folded; patterns of what a sentence says of its subject.
TITLES = frozenset({"anh", "chi", "ong", "ba", "mr", "mrs", "ms", "cau thu", "player", "tien dao", "tien ve", "hau ve", "thu mon", "trung ve", "captain", "doi truong", "cuu cau thu", "striker", "midfielder", "defender", "goalkeeper", "hlv", "coach"})
_CAPS = rf"[{''.join(c for c in alphabet() if c.isupper())}][\w'’]*"
YEAR = re.compile(r"(?:sinh năm|sinh|\bSN|born in|born|\bb\.|lứa)\s*((?:19|20)\d\d)\b|\(((?:19|20)\d\d)\)", re.IGNORECASE)
CLUB = re.compile(rf"\b(?:khoác áo|hiện chơi cho|chơi cho|bên phía|thuộc biên chế|của|from|playing for)\s+((?:CLB|Câu lạc bộ|Đội bóng)?(?:\s*{_CAPS})+)")
PROVINCE = re.compile(rf"\b(?:quê ở|quê|gốc|người|a native of|native of|hailing from)\s+({_CAPS}(?:\s+{_CAPS})*)")

#: Forms of a name, from the strongest to the weakest.
FORMS = ("marked", "folded", "order", "typo", "short", "initials", "given", "given_folded")
#: Attribute sets, from the strongest to the weakest.
WITH = ("year+club", "year+province", "year", "club", "province", "name")
#: Rules in order; the forms that a few people may share need an attribute.
RULES = [(f, w) for f in FORMS for w in WITH if not (w == "name" and f not in ("marked", "folded", "order")) and not ("+" in w and f == "typo")]
#: Forms whose rules run in each pass.
PASSES = (("marked", "folded", "order"), ("typo",), ("short", "initials", "given", "given_folded"))
#: Edits that a name may have from its entity's, where a rule leaves one word open.
MOST_EDITS = 2
#: Records with a known entity that the rules are tried on: a bound on this sample, which a hash of the id draws.
LABELLED = 20_000


def name_forms(text: str, typed: bool) -> dict[str, set[str]]:
    """Keys of a name by form. ``typed`` names may be short, abbreviated or reordered; others are whole names."""
    words = plain_name(text).split()
    plain = [bare(w) for w in words]
    while len(words) > 2:
        n = next((n for n in (3, 2, 1) if len(words) - n >= 2 and " ".join(plain[:n]) in TITLES), 0)
        if n == 0:
            break
        words, plain = words[n:], plain[n:]
    marked, folded = " ".join(words), " ".join(plain)
    out: dict[str, set[str]] = {"marked": {marked}, "folded": {folded}, "order": {" ".join(sorted(plain))}}
    if len(plain) > 2 and not any(len(w) == 1 for w in plain):
        out["typo"] = {" ".join([*plain[:i], "_", *plain[i + 1 :]]) for i in range(len(plain))}
    if typed:
        if len(plain) > 2 and any(len(w) == 1 for w in plain):
            out["initials"] = {" ".join(plain)}
        if len(plain) == 3:
            out["short"] = {" ".join(sorted(plain))}
        if len(plain) == 2:
            out["given"], out["given_folded"] = {marked}, {folded}
    elif len(plain) > 2:
        lead = plain[:-2]
        tail = " ".join(plain[-2:])
        if len(lead) > 1:
            out["short"] = {" ".join(sorted([lead[0], *plain[-2:]]))}
        short = [w[0] for w in lead]
        out["initials"] = {f"{' '.join(short)} {tail}", f"{short[0]} {tail}"} | {" ".join([*lead[:i], short[i], *lead[i + 1 :], tail]) for i in range(len(lead))}
        out["given"], out["given_folded"] = {" ".join(words[-2:])}, {tail}
    return out


def _keys(forms: dict[str, set[str]], years, clubs, provinces, wanted: tuple[str, ...] = FORMS) -> list[str]:
    """Keys (rule, form of the name, attributes) of a name for the rules of the wanted forms."""
    values = {
        "year+club": [f"{y}|{c}" for y in years for c in clubs],
        "year+province": [f"{y}|{p}" for y in years for p in provinces],
        "year": [str(y) for y in years],
        "club": list(clubs),
        "province": list(provinces),
        "name": [""],
    }
    return [f"{i}|{k}#{v}" for i, (f, w) in enumerate(RULES) if f in wanted for v in values[w] for k in forms.get(f, ())]


_FACTS = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("clubs", T.ArrayType(T.StringType())), T.StructField("provinces", T.ArrayType(T.StringType()))])


@F.pandas_udf(_FACTS)
def _facts(contexts: pd.Series) -> pd.DataFrame:
    """What each sentence says of its subject."""
    rows = []
    for c in contexts:
        c = c or ""
        year = next((int(a or b) for a, b in YEAR.findall(c)), None)
        rows.append((year, sorted({club_core(x) for x in CLUB.findall(c)} - {""}), sorted({fold(x) for x in PROVINCE.findall(c)})))
    out = pd.DataFrame(rows, columns=["year", "clubs", "provinces"])
    out["year"] = out["year"].astype("Int32")
    return out


def _key_column(typed: bool, wanted: tuple[str, ...]):
    """Keys of rows (name, years, clubs, provinces). Of typed rows those with ``trial`` have the keys of their name's derived forms, too."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(names: pd.Series, years: pd.Series, clubs: pd.Series, provinces: pd.Series, trial: pd.Series) -> pd.Series:
        from pitchlake.llm.matching import _keys, name_forms

        out = []
        for n, y, c, p, both in zip(names, years, clubs, provinces, trial):
            forms = name_forms(n, typed)
            if both:
                for f, ks in name_forms(n, False).items():
                    forms[f] = forms.get(f, set()) | ks
            out.append(_keys(forms, y, c, p, wanted))
        return pd.Series(out)

    return keys("name", "years", "clubs", "provinces", F.col("trial") if typed else F.lit(False))


@F.pandas_udf(T.BooleanType())
def _close(typed: pd.Series, names: pd.Series) -> pd.Series:
    plain = [next(iter(name_forms(t, True)["folded"])).replace(" ", "") for t in typed]
    return pd.Series([any(edits(t, fold(n).replace(" ", ""), MOST_EDITS) <= MOST_EDITS for n in ns) for t, ns in zip(plain, names)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cores(clubs: pd.Series) -> pd.Series:
    return pd.Series([sorted({club_core(c) for c in cs} - {""}) for cs in clubs])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded(values: pd.Series) -> pd.Series:
    return pd.Series([sorted({fold(v) for v in vs} - {""}) for vs in values])


@F.pandas_udf(T.StringType())
def _whole_name(s: pd.Series) -> pd.Series:
    return s.map(plain_name)


def player_profiles(entity: DataFrame) -> DataFrame:
    """(wiki_id, name, years, clubs, provinces) of each player and whole name that entity rows give.

    The linked name counts where a row has one, else the text; a name has two words or more. Repeated rows are
    pre-aggregated; a set holds the different values of one player only.
    """
    rows = entity.filter("entity_type = 'PLAYER' AND wiki_id IS NOT NULL").select(
        "wiki_id", F.coalesce("matched_name", "text").alias("name"), *[F.col("metadata")[k].alias(k) for k in ("birth_year", "club", "province")]
    )
    rows = rows.filter("name IS NOT NULL AND name <> ''").distinct()
    facts = rows.groupBy("wiki_id").agg(F.collect_set("birth_year").alias("years"), F.collect_set("club").alias("clubs"), F.collect_set("province").alias("provinces"))
    names = rows.select("wiki_id", "name").distinct().select("wiki_id", _whole_name("name").alias("name")).filter(F.size(F.split("name", " ")) >= 2).distinct()
    facts = facts.select("wiki_id", "years", _cores("clubs").alias("clubs"), _folded("provinces").alias("provinces"))
    return names.join(facts, "wiki_id")


def rule_confidences(trials: DataFrame) -> DataFrame:
    """(rule, confidence, bad): smoothed precision of each rule from its trials (rule, right); at most one row a rule.

    The counts are smoothed by two cases of the lower precision of two pools: all rules with the same attributes, where
    any was tried, and all rules with the same form. ``bad`` tells that the upper end of the Wilson interval (95 %) of the
    rule's own trials lies below one half.
    """
    tried = trials.groupBy("rule").agg(F.sum(F.col("right").cast("int")).alias("r"), F.count("*").alias("t"))
    rules = tried.sparkSession.createDataFrame([(i, f, w) for i, (f, w) in enumerate(RULES)], "rule int, form string, attributes string")
    tried = rules.join(F.broadcast(tried), "rule", "left").fillna(0, ["r", "t"])
    pool = lambda by: tried.groupBy(by).agg(((F.sum("r") + 1) / (F.sum("t") + 2)).alias(f"of_{by}"), F.sum("t").alias(f"t_{by}"))
    tried = tried.join(F.broadcast(pool("form")), "form").join(F.broadcast(pool("attributes")), "attributes")
    prior = F.when(F.col("t_attributes") > 0, F.least("of_form", "of_attributes")).otherwise(F.col("of_form"))
    share, z = F.col("r") / F.col("t"), 1.96
    upper = (share + z * z / (2 * F.col("t")) + z * F.sqrt(share * (1 - share) / F.col("t") + z * z / (4 * F.col("t") * F.col("t")))) / (1 + z * z / F.col("t"))
    return tried.select("rule", ((F.col("r") + 2 * prior) / (F.col("t") + 2)).alias("confidence"), F.when(F.col("t") > 0, upper < 0.5).otherwise(False).alias("bad"))


def match_subjects(relation: DataFrame, entity: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(relation_id, wiki_id, rule, confidence): relations without a subject id and the player each speaks of.

    Null and empty subjects and subjects unknown to ``entity`` give no row, nor do subjects that two players fit
    equally. A birth year in the sentence that differs from all the player's known ones refutes a match. ``labelled``
    bounds the relations with a subject id on which the rules are tried; without any the confidences are one half.
    """
    profiles = materialize(player_profiles(entity), "p3-profiles")
    about = profiles.groupBy("wiki_id").agg(F.first("years").alias("years"), F.collect_set("name").alias("names"))
    said = relation.filter("subject_type = 'PLAYER' AND subject_text IS NOT NULL AND trim(subject_text) <> ''")
    known = said.filter("subject_wiki_id IS NOT NULL").count()
    drawn = F.col("subject_wiki_id").isNull() | (F.pmod(F.xxhash64("relation_id"), F.lit(known)) < labelled) if known else F.lit(True)
    said = said.filter(drawn).select("relation_id", F.col("subject_wiki_id").alias("known"), F.col("subject_text").alias("name"), _facts("context").alias("f"))
    one_year = F.when(F.col("f.year").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("f.year").cast("string")))
    subjects = said.select("relation_id", "known", "name", one_year.alias("years"), "f.clubs", "f.provinces", F.col("known").isNotNull().alias("trial"))
    rest = materialize(subjects, "p3-subjects")
    rule = F.split_part("key", F.lit("|"), F.lit(1)).cast("int").alias("rule")

    parts, trials = [], []
    for forms in PASSES:
        keys = profiles.select("wiki_id", F.explode(_key_column(False, forms)).alias("key"))
        keys = keys.groupBy("key").agg(F.min("wiki_id").alias("wiki_id"), F.max("wiki_id").alias("other")).filter("wiki_id = other").drop("other")
        verified = ["name"] if "typo" in forms else []  # what is checked after the join goes with the keys
        asked = rest.select("relation_id", "known", F.get("years", F.lit(0)).alias("said"), *verified, F.explode(_key_column(True, forms)).alias("key"))
        fits = asked.join(keys, "key").select("relation_id", "known", "said", *verified, rule, "wiki_id").join(about, "wiki_id")
        fits = fits.filter("said IS NULL OR size(years) = 0 OR array_contains(years, said)")
        if verified:
            fits = fits.filter(_close("name", "names"))
        fits = materialize(fits.select("relation_id", "known", "rule", "wiki_id"), "p3-fits")
        tried = fits.filter("known IS NOT NULL").distinct()
        trials.append(tried.select("rule", (F.col("known") == F.col("wiki_id")).alias("right")))
        low, high = F.min(F.struct("rule", "wiki_id")).alias("low"), F.max(F.struct(-F.col("rule"), "wiki_id")).alias("high")
        found = fits.filter("known IS NULL").groupBy("relation_id").agg(low, high).filter("low.wiki_id = high.wiki_id")
        parts.append(found.select("relation_id", "low.wiki_id", "low.rule"))
        if forms != PASSES[-1]:
            rest = rest.join(found.select("relation_id"), "relation_id", "left_anti")
    names = F.array(*[F.lit(f"{f}/{w}") for f, w in RULES])
    known_good = rule_confidences(reduce(DataFrame.unionByName, trials)).filter("NOT bad").drop("bad")
    matched = reduce(DataFrame.unionByName, parts).join(F.broadcast(known_good), "rule")
    return matched.select("relation_id", "wiki_id", names[F.col("rule")].alias("rule"), "confidence")
