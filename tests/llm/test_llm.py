"""Operators on text: hand-written cases, brute force, round trips, edge cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pitchlake.llm import canonical, lookalikes, matching, mixing, names, privacy, tokenizer, variants, wordsets

VOCABULARY = tokenizer.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")


def odd_texts():
    rnd = random.Random(5)
    texts = ["", "a" * 5000, "ab" * 3000 + " x", "<|endoftext|> hi", "  \n\n  x ", "x\x1cy \x1c z", " a  b", "﻿​ é", "\t\t", "it's I'LL 'sdf  's", "１２３ abc\x00d", "🏆⚽👨‍👩‍👧" * 50, "x\x85y", "\xa0\xa0a\xa0 b", "Đội tuyển Lạc Hoan"]
    texts += ["".join(rnd.choice("ab c\n\tđé1'.　") for _ in range(rnd.randint(1, 3000))) for _ in range(20)]
    return texts + ["".join(rnd.choice("abcde") for _ in range(rnd.randint(2000, 4000))) for _ in range(5)]


@needs_vocabulary
def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    own = tokenizer.Encoder(tokenizer.read_tables(VOCABULARY))
    other = Tokenizer.from_file(VOCABULARY)
    other.encode_special_tokens = True
    texts = odd_texts()
    values, bounds = own.encode(texts)
    for i, t in enumerate(texts):
        assert values[bounds[i] : bounds[i + 1]].tolist() == other.encode(t, add_special_tokens=False).ids
        assert other.decode(values[bounds[i] : bounds[i + 1]].tolist()) == t or "\x00" in t


@needs_vocabulary
def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (3, "", 5), (3, "", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, len(r.ids)) for r in tokenizer.encode_corpus(df, "doc_id", "text", VOCABULARY).collect())
    assert got == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert tokenizer.encode_corpus(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0
    counted = tokenizer.count_tokens(df.select("doc_id", "text"), "text", VOCABULARY)
    assert sorted(r.n_tokens for r in counted.collect()) == [0, 0, 0, 2]


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("Lạc Hoan", "Lạc Hoan"), ("Lạc Hoan", "Lạc Hoan"), ("ＦＣ Nịp", "FC Nịp"), ("A\xa0B", "A B"), ("A  B ", "A B"), ("A​B", "AB"), ("﻿A", "A"), ("Foоtball", "Football"), ("Ðội", "Đội"),
        ("Νhạ", "Nhạ"), ("Жои Вдтро", "Жои Вдтро"), ("이노우나\xad", "이노우나"), ("ネヌア", "ネヌア"), ("", ""), ("Müller", "Muller"), ("CLB Cao Su – X", "CLB Cao Su – X"), ("Ｕ-２3", "U-23"), ("a\tb", "a b"),
    ],
)
def test_plain_form(spark, text, plain):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    assert lookalikes.plain_text(df, ["t"]).first()["t_plain"] == plain
    assert lookalikes.not_plain(df, "id", ["t"]).count() == int(text != plain)


def test_plain_form_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "a  b", None), (2, "y" * 300_000 + "​", "")], "id long, t string, u string")
    assert sorted(map(tuple, lookalikes.not_plain(df, "id", ["t", "u"]).collect())) == [(1, "t"), (2, "t")]
    assert lookalikes.not_plain(df.limit(0), "id", ["t"]).count() == 0
    twice = lookalikes.plain_text(lookalikes.plain_text(df.select("id", "t"), ["t"]).select("id", F.col("t_plain").alias("t")), ["t"])
    assert twice.filter("NOT t <=> t_plain").count() == 0


PROVINCES = [{"name": n} for n in ("Mọc Miền", "Táu Nhĩm", "Tộc Rẹc", "Hóng Bạch")]
POSITIONS = [
    {"position_code": c, "position_name": e, "position_name_vi": v}
    for c, e, v in (("GK", "Goalkeeper", "Thủ môn"), ("MF", "Midfielder", "Tiền vệ"), ("CM", "Central midfielder", "Tiền vệ trung tâm"), ("FW", "Forward", "Tiền đạo"), ("ST", "Striker", "Tiền đạo cắm"), ("LB", "Left back", "Hậu vệ trái"))
]


@pytest.mark.parametrize(
    ("value", "target"),
    [
        ("Mọc Miền", "Mọc Miền"), ("TP. Moc Mien", "Mọc Miền"), ("MocMien", "Mọc Miền"), ("M. Miền", "Mọc Miền"), ("[[Tộc Rẹc (tỉnh)|Tộc Rẹc]]", "Tộc Rẹc"), ("xã Nè Voạt, huyện Hẹp Quích, Táu Nhĩm, Lạc Hoan", "Táu Nhĩm"),
        ("làng Tuy Hiển (nay thuộc Hóng Bạch)", "Hóng Bạch"), ("Tol Re", "Tộc Rẹc"), ("Táu-Nhĩm", "Táu Nhĩm"), ("huyện Khép Liễng", "UNMATCHED"), ("nước ngoài", "UNMATCHED"), ("", "UNMATCHED"), ("?", "UNMATCHED"), ("xã Mọc Miền", "UNMATCHED"), ("Port Darnelo, Yorneertia", "UNMATCHED"),
    ],
)
def test_places(value, target):
    assert canonical.place_canonicalizer(PROVINCES).map(value) == target


@pytest.mark.parametrize(
    ("value", "target"),
    [("gk", "GK"), ("G.K.", "GK"), ("Tiền vệ truvg tâm", "CM"), ("Tien ve", "MF"), ("Tiền đo cắm", "ST"), ("fforward", "FW"), ("L. back; GK", "LB"), ("Tiền đạo (FW) / GK", "FW"), ("Trọng tài", "UNMATCHED"), ("10", "UNMATCHED"), ("thủ môn, tiền vệ", "GK")],
)
def test_positions(value, target):
    assert canonical.position_canonicalizer(POSITIONS).map(value) == target


def test_sets_of_words():
    e = canonical.set_errors
    assert e(("tien", "ve"), ("tien", "ve"), 2) == 0 and e(("ve", "tien"), ("tien", "ve"), 2) == 1 and e(("tien", "vee"), ("tien", "ve"), 2) == 1
    assert e(("tien", "ve"), ("tien", "ve", "x"), 2) == 1 and e(("tien",), ("tien", "canh"), 2) == 3 and e(("vo", "phich"), ("khich", "ve"), 2) == 3 and e((), ("a",), 2) == 1
    long = [("CM", "Tiền vệ trung tâm lùi sâu phía trước hàng hậu vệ")]
    c = canonical.Canonicalizer([*long, ("GK", "Thủ môn")], first=True)
    for typed in ("Tiền vệ trugn tâm lùi sâu phía trước hàng hậu vệ", "trung tâm Tiền vệ lùi sâu phía trước hàng hậu vej", "Tiền vệ trung tâm lùisâu phía trước hàng hậu"):
        assert c.map(typed) == "CM" and len(typed) > 40
    assert c.map("Tiền vệ " + "x" * 5000) == "UNMATCHED" and c.map("x" * 100_000) == "UNMATCHED" and c.map("a " * 20_000) == "UNMATCHED"


def test_canonical_column(spark):
    c = canonical.place_canonicalizer(PROVINCES)
    df = spark.createDataFrame([("moc mien",), (None,), ("x " * 50_000 + ", Táu Nhĩm",), ("moc mien",)], "v string")
    assert [r[0] for r in df.select(canonical.to_canonical(F.col("v"), c)).collect()] == ["Mọc Miền", None, "Táu Nhĩm", "Mọc Miền"]
    assert df.limit(0).select(canonical.to_canonical(F.col("v"), c)).count() == 0


def test_edits_and_deletions():
    assert names.edits("trno", "tron", 2) == 1 and names.edits("abc", "abc") == 0 and names.edits("abcd", "x", 2) == 3
    assert names.deletions("abc", 1) & names.deletions("acb", 1)
    assert names.club_core("Câu lạc bộ bóng đá Đạ Thúc B") == "da thuc b"


ENTITY = "entity_id long, text string, entity_type string, wiki_id long, matched_name string, metadata map<string,string>"
RELATION = "relation_id long, subject_text string, subject_type string, subject_wiki_id long, context string, wiki_id long"


def test_cascade(spark):
    entity = spark.createDataFrame(
        [
            (1, "x", "PLAYER", 100, "Mẻng Sứt Nguyệt Tảng", {"birth_year": "1970", "club": "CLB Roán Chin"}),
            (2, "x", "PLAYER", 100, "Mẻng Sứt Nguyệt Tảng", None),
            (3, "x", "PLAYER", 101, "Hẹn Xằm Diệp Phẩu", {"birth_year": "1976"}),
            (4, "x", "PLAYER", 102, "Hẹn Xằm Diệp Phẩu", {"birth_year": "1996", "province": "Kíp Mướn"}),
            (5, "x", "CLUB", 900, "Hẹn Xằm", None),
            (6, None, "PLAYER", 103, None, None),
        ],
        ENTITY,
    )
    relation = spark.createDataFrame(
        [
            (1, "Mẻng Sứt Nguyệt Tảng", "PLAYER", None, "Mẻng Sứt Nguyệt Tảng sinh năm 1970 đã thi đấu", 1),
            (2, "MENG SUT NGUYET TANG", "PLAYER", None, "MENG SUT NGUYET TANG khoác áo Câu lạc bộ Roán Chin ghi bàn", 1),
            (3, "Mẻng Sứt Nguyệt Tảngg", "PLAYER", None, "SN 1970", 1),
            (4, "Nguyệt Tảng Mẻng Sứt", "PLAYER", None, "b. 1970", 1),
            (5, "anh Nguyệt Tảng", "PLAYER", None, "lứa 1970", 1),
            (6, "M. Nguyệt Tảng", "PLAYER", None, "(1970)", 1),
            (7, "Mẻng Sứt Nguyệt Tảng", "PLAYER", None, "born in 1980", 1),
            (8, "Hẹn Xằm Diệp Phẩu", "PLAYER", None, "không nói gì", 1),
            (9, "Hẹn Xằm Diệp Phẩu", "PLAYER", None, "người Kíp Mướn chuyển sang", 1),
            (10, "Hẹn Xằm Diệp Phẩu", "PLAYER", 101, "b. 1976", 1),
            (11, None, "PLAYER", None, "b. 1976", 1),
            (12, "", "PLAYER", None, None, 1),
            (13, "Lạ Hoàn Toàn", "PLAYER", None, "b. 1976", 1),
        ],
        RELATION,
    )
    got = {(r.relation_id, r.wiki_id) for r in matching.match_subjects(relation, entity).collect()}
    assert got == {(1, 100), (2, 100), (3, 100), (4, 100), (5, 100), (6, 100), (9, 102)}
    assert matching.match_subjects(relation.limit(0), entity).count() == 0
    assert matching.match_subjects(relation, entity.limit(0)).count() == 0


def people(n):
    """Players of four-word names with a year and a club, and the entity rows that tell of them."""
    lead, middle, given = ("Mẻng", "Hẹn", "Lường", "Quảnh", "Tạc"), ("Sứt", "Xằm", "Tuy", "Rửu", "Lây"), ("Nguyệt", "Diệp", "An", "Thúc", "Sẹc")
    names_ = [f"{lead[i % 5]} {middle[i // 5 % 5]} {given[i // 25 % 5]} Phẩu{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(n)]
    return names_, [(i, "x", "PLAYER", 1000 + i, name, {"birth_year": str(1960 + i % 40), "club": f"CLB Roán Chin{chr(97 + i % 7)}"}) for i, name in enumerate(names_)]


def test_wrong_labels_remove_no_rule(spark):
    names_, rows = people(120)
    entity = spark.createDataFrame(rows, ENTITY)
    asked = [(i, n[:-1] + "xx" if i % 3 == 0 else f"{n[0]}. {' '.join(n.split()[2:])}" if i % 3 == 1 else n.upper(), "PLAYER", None, f"sinh năm {1960 + i % 40}", 1) for i, n in enumerate(names_[:60])]
    known = [(500 + i, n, "PLAYER", 1060 + i, f"b. {1960 + (60 + i) % 40}", 1) for i, n in enumerate(names_[60:])]
    got = {}
    for wrong in (0, 1, 60):
        relation = spark.createDataFrame(asked + [(k, n, t, 7 if i < wrong else w, c, x) for i, (k, n, t, w, c, x) in enumerate(known)], RELATION)
        got[wrong] = {(r.relation_id, r.wiki_id): r.confidence for r in matching.match_subjects(relation, entity).collect()}
    assert set(got[0]) == set(got[1]) == {(i, 1000 + i) for i in range(60)}
    assert min(got[0].values()) > 0.95 and all(got[1][k] <= v for k, v in got[0].items())
    assert not got[60]  # rules that are shown to be bad give nothing
    few = matching.match_subjects(spark.createDataFrame(asked + known, RELATION), entity, labelled=5)
    assert {(r.relation_id, r.wiki_id) for r in few.collect()} == set(got[0])


def test_rule_confidences(spark):
    i = {r: n for n, r in enumerate(matching.RULES)}
    trials = [(i["marked", "year"], True)] * 98 + [(i["marked", "year"], False)] * 2 + [(i["typo", "year"], False)]
    got = {r.rule: r for r in matching.rule_confidences(spark.createDataFrame(trials, "rule int, right boolean")).collect()}
    assert len(got) == len(matching.RULES) and not any(r.bad for r in got.values())
    assert abs(got[i["marked", "year"]].confidence - (98 + 2 * 99 / 103) / 102) < 0.01 and got[i["marked", "club"]].confidence > 0.95
    assert got[i["typo", "year"]].confidence < 0.34 and got[i["given", "club"]].confidence == 0.5


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables here")
def test_blinded_labels_are_found_again(spark):
    from pitchlake.session import table

    relation, entity = (table(spark, "/root/testdata/sf0.01", t) for t in ("relation", "entity"))
    blind = (F.col("relation_id") % 2 == 0) & F.col("subject_wiki_id").isNotNull() & (F.col("subject_type") == "PLAYER")
    told = relation.filter(blind).select("relation_id", F.col("subject_wiki_id").alias("truth"))
    told = told.join(matching.player_profiles(entity).select(F.col("wiki_id").alias("truth")).distinct(), "truth", "left_semi")  # others entity doesn't know
    found = matching.match_subjects(relation.withColumn("subject_wiki_id", F.when(~blind, F.col("subject_wiki_id"))), entity)
    both = told.join(found, "relation_id", "left").agg(F.count("*").alias("n"), F.count("wiki_id").alias("found"), F.count_if(F.col("wiki_id") == F.col("truth")).alias("right")).first()
    assert both.right >= 0.9 * both.n and both.right >= 0.99 * both.found


def test_variants(spark):
    rows = [("club_name", n) for n in ("CLB Đóp Troi", "Đóp Troi FC", "F.C. DOP TROI", "Clb. Đóp-Troi", "CLB Cao Su – Đóp Troi", "Đóp Troii FC", "Đóp Troi B FC", "ĐT Đóp Troi", "Reo Nhoạt FC", None, "", "CLB")]
    rows += [("chairman", n) for n in ("Quảnh Rửu Thúc Toành", "QUẢNH RỬU THÚC TOÀNH", "quanh ruu thuc toanh", "Q. R. Thúc Toành", "Ông Thúc Toành", "Thúc Toành, Quảnh Rửu", "Quảnh Rửu Thúc-Toành (Gấu)", 'Quảnh "Tí" Thúc Toành', "Quảh Rửu Thúc Toành", "Quảnh Bấu Lây Khoi", "Quảnh Bấu Sẹc Bịa")] * 2
    rows += [("manager", "Ông Thúc Toành")]
    df = spark.createDataFrame(rows, "field string, name string").withColumn("entity", F.lit(1))
    found = variants.resolve(df.select("field", "name"), {"club_name": False, "chairman": True, "manager": True})
    groups = {}
    for r in found.collect():
        groups.setdefault((r.field, r.entity), set()).add(r.name)
    clubs = next(g for (f, _), g in groups.items() if f == "club_name" and "Đóp Troi FC" in g)
    assert clubs == {"CLB Đóp Troi", "Đóp Troi FC", "F.C. DOP TROI", "Clb. Đóp-Troi", "CLB Cao Su – Đóp Troi", "Đóp Troii FC", "ĐT Đóp Troi"}
    people = next(g for (f, _), g in groups.items() if f == "chairman" and "Ông Thúc Toành" in g)
    assert len(people) == 9 and "Quảnh Bấu Lây Khoi" not in people
    assert ("manager", "Ông Thúc Toành") in {(f, n) for (f, _), g in groups.items() for n in g}
    pairs = variants.linked_pairs(found).filter("field = 'club_name'").collect()
    assert len(pairs) == 21 and all(r.name_a < r.name_b for r in pairs)
    assert variants.resolve(df.limit(0).select("field", "name"), {"club_name": False, "chairman": True}).count() == 0


def test_errors_in_several_dressings(spark):
    clubs = ["CLB Đóp Troi"] * 40 + ["Đóp Troi FC", "Đóp Troi B FC", "Đóp Troii FC", "Đóp Troii FC", "CLB Đóp Troii", "ĐÓP TROII", "Reo Nhoạt FC", "CLB Reo Nhoạt"]
    people = ["Quảnh Rửu Thúc Toành"] * 20 + ["QUẢNH RỬU THÚC TOÀNH", "Quảh Rửu Thúc Toành", "QUẢH RỬU THÚC TOÀNH", "Quảnh Bấu Lây Khoi", "QUẢNH BẤU LÂY KHOI"]
    rows = [("club_name", n) for n in clubs] + [("chairman", n) for n in people]
    groups = {}
    for r in variants.resolve(spark.createDataFrame(rows, "field string, name string"), {"club_name": False, "chairman": True}).collect():
        groups.setdefault(r.entity, set()).add(r.name)
    assert {"CLB Đóp Troi", "Đóp Troi FC", "Đóp Troii FC", "CLB Đóp Troii", "ĐÓP TROII"} in groups.values()
    assert {"Quảnh Rửu Thúc Toành", "QUẢNH RỬU THÚC TOÀNH", "Quảh Rửu Thúc Toành", "QUẢH RỬU THÚC TOÀNH"} in groups.values()
    assert {"Reo Nhoạt FC", "CLB Reo Nhoạt"} in groups.values() and {"Quảnh Bấu Lây Khoi", "QUẢNH BẤU LÂY KHOI"} in groups.values()


def test_merges_settle(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 5), (6, 5), (7, 8), (8, 9), (9, 7)], "entity long, target long")
    assert {tuple(r) for r in variants.settled(links).collect()} == {(2, 1), (4, 5), (6, 5)}
    # two clusters that each hold a short and a whole form of the other still end
    rows = [("chairman", n) for n in ("Quảnh Rửu Thúc Toành", "Quảnh Thúc Toành", "Quảnh Rửu Lây Khoi", "Quảnh Lây Khoi", "Quảnh Lây Khoi Rửu")]
    found = variants.resolve(spark.createDataFrame(rows, "field string, name string"), {"chairman": True})
    assert found.count() == 5 and found.select("entity").distinct().count() == 2


def test_personal_names_listed_without_marks(spark):
    public = [("Luong Tuy An Binh",)] + [(f"Lường Tuy Kề Cận{c}",) for c in "abcdefgh"]
    docs = [(1, "Ký tên: Lường Tuy An Bình, đội trưởng."), (2, "Ký tên: LUONG TUY AN BINH."), (3, "Ký tên: Lường Tuy Xa Lạ."), (4, "Ký tên: Lường Tuy Ke Can.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = privacy.personal_information(df, "doc_id", "text", spark.createDataFrame(public, "name string"))
    assert {r.doc_id for r in found.filter("pii_type = 'name'").collect()} <= {3, 4}
    assert privacy.name_keys("Ông Lường Tuy An Bình") == ("an bình lường tuy", "an binh luong tuy", True)


def test_mix(spark):
    rows = [(i, "a" if i % 3 else "b", 10 + i % 7) for i in range(3000)] + [(9001, None, 5), (9002, "a", 0), (9003, "z", 7), (9003, "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = [("a", 0.4, 1), ("b", 0.5, 3), ("none", 0.1, 2)]
    out, budgets = mixing.mix(df, targets)
    got = out.collect()
    caps = {"a": 1, "b": 3}
    assert {r.source for r in got} == {"a", "b"} and all(1 <= r.copies <= caps[r.source] for r in got)
    total = sum(r.copies * r.n_tokens for r in got)
    for b in budgets:
        share = sum(r.copies * r.n_tokens for r in got if r.source == b.source) / total
        assert abs(share - {"a": 4 / 9, "b": 5 / 9}[b.source]) < 0.002
    report = mixing.shares(out, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")).collect()
    assert {r.source: r.docs for r in report}["none"] == 0 and abs(sum(r.actual_share for r in report) - 1) < 1e-9
    assert mixing.mix(df.limit(0), targets)[0].count() == 0
    assert mixing.mix(df, [])[0].count() == 0


def test_direct_identifiers():
    text = (
        "Liên hệ a.b+c@mail.example, x91 a còng post chấm test hoặc d[at]post[dot]example. đt 0658.224.799 / (067) 035 3519 / +84 63 322 8990 / 0084 608 944 010, "
        "không sáu hai không một ba không sáu sáu bảy. CMND 097.751.408197, 978 232 420, Z 6633999. Mã vé 866811159531, hóa đơn 0287079474/HĐ, 526.452.500 lượt, https://tin.example/x/526423066?ref=@khandai. "
        "Trú tại 7 hẻm 282/10 đường Dịa Nhèo, xã Nển Giư, huyện Triêng Huống, tỉnh Toản Rược đến sân. I live at 118B Hì Kệp Road, Coạn Giệch district, Thí Đượp and."
    )
    found = [(text[s:e], k) for s, e, k in privacy.direct_identifiers(text)]
    assert [x for x, k in found if k == "email"] == ["a.b+c@mail.example", "x91 a còng post chấm test", "d[at]post[dot]example"]
    assert [x for x, k in found if k == "phone"] == ["0658.224.799", "(067) 035 3519", "+84 63 322 8990", "0084 608 944 010", "không sáu hai không một ba không sáu sáu bảy"]
    assert [x for x, k in found if k == "id_number"] == ["097.751.408197", "978 232 420", "Z 6633999"]
    assert [x for x, k in found if k == "address"] == ["7 hẻm 282/10 đường Dịa Nhèo, xã Nển Giư, huyện Triêng Huống, tỉnh Toản Rược", "118B Hì Kệp Road, Coạn Giệch district, Thí Đượp"]


def test_places_and_contexts():
    text = "An Le gặp An Lee, số 0658224799 trong mã 06582247991"
    assert privacy.replace_spans(text, [(0, 5, "name"), (21, 31, "phone")]) == "[NAME] gặp An Lee, số [PHONE] trong mã 06582247991"
    long = "x" * 500
    assert privacy._context(f"{long} {long} Tên {long} y", 1003, 1005) == privacy._context(f"a {long} {long} Tên {long} y", 1005, 1007)
    assert privacy._context(f"{long} Tên", 501, 504) == [f"<1 {long}"]


def test_names_of_any_length():
    low = lambda *ws: frozenset(ws)
    names_ = privacy.Lexicon(low("lường"), low("tuy"), low("an", "bình"), low("hoà", "thuận"))
    found = lambda t: [t[s:e] for s, e, _ in privacy.name_terms(t, names_)]
    assert found("gặp Lường Tuy An Bình Hoà Thuận Gửi ảnh") == ["Lường Tuy An Bình Hoà Thuận"]
    assert found("gặp Lường An Khang Gửi ảnh") == ["Lường An Khang"]
    assert found("gặp Lường Tuy Lạ Lẫm.") == ["Lường Tuy Lạ Lẫm"]


def test_identifiers_need_personal_contexts(spark):
    docs = [(i, f"Mã vé 06582247{i:02d} hết hạn") for i in range(3)] + [(10 + i, f"Mã vé 8658111595{i:02d}9123 hết hạn") for i in range(30)]
    docs += [(50 + i, f"gọi 06582248{i:02d} nhé") for i in range(10)]
    found = privacy.personal_information(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([("Lường Tuy An",)], "name string"))
    assert {r.doc_id for r in found.collect()} == set(range(50, 60))


def test_unlisted_names_without_marks(spark):
    public = [("Lường Tuy An Bình",), ("Lường Tuy Kề Cận",)]
    docs = [(1, "Ký tên: LUONG TUY AN BINH."), (2, "Ký tên: Luong Tuy La Lam."), (3, "Ký tên: Luong Tuy Ke Can."), (4, "Ký tên: Lường Tuy Lạ Lùng.")]
    found = privacy.personal_information(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(public, "name string"))
    assert {r.doc_id for r in found.collect()} == {2, 4}


def test_word_filter(spark):
    words = spark.createDataFrame([("lường",), ("tuy",), ("đỗ",)], "w string")
    held = wordsets.WordFilter(wordsets.filter_bits(words))
    assert all(w in held for w in ("lường", "~luong", "~do")) and "luong" not in held and "an" not in held
    assert "x" not in wordsets.WordFilter(wordsets.filter_bits(words.limit(0)))


def test_personal_information(spark):
    public = [(f"Lường Tuy An Bình{chr(97 + i)}",) for i in range(20)]
    docs = [(i, f"Phút 5, {public[i % 20][0]} ghi bàn cho đội.", "x") for i in range(60)]
    docs += [(100 + i, f"Ký tên: Lường Tuy Kín Đáo{chr(97 + i)}, gọi 0658224799.", "x") for i in range(10)]
    docs += [(200, "Ký tên: L. Kín Đáo", "x"), (201, None, "x"), (202, "", "x"), (203, "z" * 200_000 + " Ký tên: Lường Tuy Lạ Lẫm.", "x"), (203, "z", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, pii_text string")
    names_ = spark.createDataFrame([*public, (None,), ("",)], "name string")
    found = privacy.personal_information(df, "doc_id", "text", names_)
    got = {tuple(r) for r in found.collect()}
    assert {(100 + i, "name", f"Lường Tuy Kín Đáo{chr(97 + i)}") for i in range(10)} <= got
    assert {(100, "phone", "0658224799"), (200, "name", "L. Kín Đáo"), (203, "name", "Lường Tuy Lạ Lẫm")} <= got
    assert not [x for x in got if x[0] < 100]
    clean = {r.doc_id: r.text for r in privacy.sanitise(df, "doc_id", "text", names_).collect()}
    assert clean[100] == "Ký tên: [NAME], gọi [PHONE]." and clean[201] is None and clean[202] == "" and clean[0] == docs[0][1]
    assert privacy.personal_information(df.limit(0), "doc_id", "text", names_).count() == 0
    assert privacy.personal_information(df, "doc_id", "text", names_.limit(0)).filter("pii_type = 'phone'").count() == 10


def test_names_in_a_mostly_private_corpus(spark):
    public = [(f"Lường Tuy An Bình{chr(97 + i)}",) for i in range(20)]
    docs = [(i, f"Ký tên: Lường Tuy Kín Đáo{chr(97 + i % 26)}{chr(97 + i // 26)}, gọi.") for i in range(90)]
    docs += [(100 + i, f"Phút 5, {public[i][0]} ghi bàn cho đội.") for i in range(10)] + [(200, "Receipt issued to Lường Tuy Lạ Lẫm.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = privacy.personal_information(df, "doc_id", "text", spark.createDataFrame(public, "name string"))
    assert {r.doc_id for r in found.filter("pii_type = 'name'").collect()} == {*range(90), 200}
    clean = {r.doc_id: r.text for r in privacy.sanitise(df, "doc_id", "text", spark.createDataFrame(public, "name string")).collect()}
    assert clean[0] == "Ký tên: [NAME], gọi." and clean[100] == docs[90][1]


@needs_vocabulary
def test_very_long_words_are_merged_around():
    from tokenizers import Tokenizer

    own, other = tokenizer.Encoder(tokenizer.read_tables(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(7)
    words = ["a" * 5001, "ab" * 4000, "".join(rnd.choice("abcdefghij") for _ in range(60_000)), "đ" * 3000, "aab" * 2500, "na" * 3 + "an" * 2000]
    for w, ids, alone in zip(words, own.merge([w.encode() for w in words]), own._merge_around([w.encode() for w in [*words, "x", "ab"]])):
        assert ids.tolist() == alone.tolist() == other.encode(w, add_special_tokens=False).ids


def test_surnames(spark):
    full = [f"Quảnh {m} {g} Phẩu{c}" for m in ("Rửu", "Tuy") for g in ("An", "Lây") for c in "abc"] + ["An Phẩua Quảnh Rửu", "Ông Hiếm Tuy Lây Phẩua"]
    known = wordsets.WordFilter(variants.surname_bits(spark.createDataFrame([(n,) for n in full], "name string")))
    assert "quanh" in known and not any(w in known for w in ("ruu", "an", "hiem", "ong"))
    assert "quanh" not in wordsets.WordFilter(variants.surname_bits(spark.createDataFrame([], "name string")))


def test_set_errors_is_brute_force():
    from itertools import permutations

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3)))
    for _ in range(400):
        a, b = tuple(word() for _ in range(rnd.randint(1, 3))), tuple(word() for _ in range(rnd.randint(1, 3)))
        short, long = sorted((a, b), key=len)
        best = 99
        slots = [*range(len(long)), *[None] * len(short)]
        for order in set(permutations(slots, len(short))):
            taken = [j for j in order if j is not None]
            n = sum(len(w) if j is None else names.edits(w, long[j], 9) for w, j in zip(short, order)) + sum(len(w) for j, w in enumerate(long) if j not in taken)
            best = min(best, n + (taken != sorted(taken)))
        assert canonical.set_errors(a, b, 2) == min(best, 3), (a, b)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["p2_found", "p3_matches", "p5_found", "p7_plain", "p9_shares", "p10_sanitised"])
def test_empty_tables(spark, tmp_path, name):
    from pitchlake.llm import queries

    for f in os.listdir("/root/testdata/sf0.001"):
        spark.read.parquet(f"/root/testdata/sf0.001/{f}").limit(0).coalesce(1).write.parquet(str(tmp_path / f))
    assert getattr(queries, name)(spark, str(tmp_path)).count() == 0
