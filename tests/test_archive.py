import zipfile

import pytest

from verbatlas.operators import audit
from verbatlas.sources import archive

TREE = "( (S (NP-SBJ (NNP Ines)) (VP (VBD shipped) (NP (-NONE- *PRO*)) (NP (DT the) (NN crate))) (. .)) )\n"
ROW = "0 1 gold ship-v ship.01 ----- 0:1-ARG0 1:0-rel 3:1-ARG1\n"
FOLDERS = {"txt": "Propbank/MASC1_textfiles", "mrg": "Propbank/Penn_Treebank-orig/data", "prop": "Propbank/Propbank-orig/data"}


def make(path, extra=(), **documents):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("Propbank/README.txt", "x")
        for name, parts in documents.items():
            for kind, content in parts.items():
                z.writestr(f"{FOLDERS[kind]}/written/{name}.{kind}", content)
        for member, content in extra:
            z.writestr(member, content)
    return str(path)


def test_decoding():
    assert archive.decode_bytes("﻿é".encode()) == ("é", "utf-8-sig")
    assert archive.decode_bytes("é".encode("utf-16")) == ("é", "utf-16")
    assert archive.decode_bytes(b"caf\xe9s") == ("cafés", "cp1252") and archive.decode_bytes(None) == (None, None)
    assert archive.decode_bytes(b"\x81") == (None, "none")


def test_report_reconciles(spark, tmp_path):
    whole = {"txt": "t", "mrg": TREE, "prop": ROW}
    path = make(
        tmp_path / "a.zip", [("../up.txt", "x"), ("Propbank/LICENSE", "x"), ("Propbank/.svn/x", "y")],
        a=whole, b=whole | {"mrg": TREE + "("}, c={"txt": "t", "mrg": TREE}, wsj_1=whole | {"prop": ROW + ROW},
        d=whole | {"prop": "0 1 gold ship-v ship.01 ----- 0:1-ARG0 1:0-rel 2:1-ARG1\n"}, e=whole | {"prop": ROW + "7 1 gold ship-v ship.01 ----- 1:0-rel\n"},
    )
    with pytest.raises(ValueError):
        audit.audit_archive(spark, path, ["a"])
    report = audit.audit_archive(spark, path, ["a", "b", "c", "d", "e", "wsj_1"], allow_unpinned=True)
    assert report["archive"]["unsafe_paths"] == ["../up.txt"] and report["archive"]["status"] == "fail" and report["archive"]["svn_files_ignored"] == 1
    assert report["archive"]["archive_level_legal_notice_files"] == ["Propbank/LICENSE"]
    assert report["join"]["missing_by_layer"] == {"text": [], "ptb": [], "prop": ["c"]}
    assert report["join"]["canonical_prop_rows"] == 7 and report["join"]["full_join_failures"] == {"ptb_document_missing_or_invalid": 1, "sentence_index_out_of_range": 1}
    assert report["join"]["exact_duplicate_predicate_instances"] == 1
    assert {k: v["reasons"] for k, v in report["g2"]["exclusions"].items()} == {
        "b": ["ptb_tree_syntax_invalid"], "c": ["prop_layer_missing"], "e": ["sentence_index_out_of_range"], "wsj_1": ["wsj_denied_override"]}
    assert report["g2"]["retained_documents"] == 2 and report["g3"]["eligible_verbal_records"] == 2
    assert report["g3"]["conversion_failures"] == {"argument_has_no_surface_realization": 1} and report["g3"]["conversion_coverage"] == 0.5
    assert report["g3"]["structural_findings"] == {"no_surface_arguments": 1, "records_examined": 2, "records_with_no_surface": 1, "records_with_unlinked_no_surface": 1,
                                                   "records_with_unlinked_unindexed_pro": 1, "unlinked_no_surface_arguments": 1}
    assert report["decision"]["overall"] == "no_go"


def test_member_ranges_and_prefixes(spark, tmp_path):
    path = make(tmp_path / "a.zip", a={"txt": "t", "prop": ROW})
    rows = archive.read_archive(spark, path, prefixes=("Propbank/Propbank-orig/",)).collect()
    assert len(rows) == 3 and [r.content is not None for r in rows] == [False, False, True]
    assert archive.read_archive(spark, path, content=False).where("content is not null").count() == 0
    assert archive.check_pin(path, "a.zip", 1, "x") == {"filename": True, "bytes": False, "sha256": False}


def test_negative_members(spark, tmp_path):
    """Links, encrypted and damaged members, collisions, bytes that are no archive, and any Spark path."""
    path = tmp_path / "n.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, attributes, flag, damage in (("a", 0, 0, 0), ("A", 0, 0, 0), ("link", 0o120777 << 16, 0, 0), ("secret", 0, 1, 0), ("bad", 0, 0, 1), ("x/../y", 0, 0, 0), ("d/", 0, 0, 0)):
            info = zipfile.ZipInfo(name)
            z.writestr(info, "x" if name != "d/" else "")
            info.external_attr, info.flag_bits, info.CRC = attributes, info.flag_bits | flag, info.CRC ^ damage
    (tmp_path / "no.zip").write_bytes(b"not an archive")
    for rows in (archive.read_archive(spark, str(path)), archive.read_archives(spark, str(path))):
        marked = audit.classified(rows)
        assert {tuple(r) for r in audit.problem_paths(marked).collect()} == {("symlink", "link"), ("encrypted", "secret"), ("damaged", "bad"), ("unsafe", "x/../y")}
        facts = audit.safety_facts(marked).first()
        assert (facts.entries, facts.files, facts.casefold_collisions, facts.duplicate_names, facts.damaged) == (7, 6, 1, 0, 1)
        assert {r.path: r.content for r in rows.collect()} == {"a": b"x", "A": b"x", "link": b"x", "secret": None, "bad": None, "x/../y": b"x", "d/": None}
    assert archive.read_archives(spark, str(tmp_path / "no.zip")).collect()[0].path is None
    found = archive.fingerprints(spark, str(path)).first()
    assert (found.name, found.bytes, found.sha256) == archive.fingerprint(str(path))


def test_paths_of_any_length(spark):
    path = "Propbank/MASC1_textfiles/written/" + "x" * 20_000 + ".txt"
    rows = spark.createDataFrame([(path, False, 0, 0)], "path string, is_dir boolean, flags int, external_attr bigint")
    found = audit.classified(rows).first()
    assert found.genre == "written" and found.document_id == "x" * 20_000
