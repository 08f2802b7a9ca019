"""Providers, the registry's export and what a snapshot carries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrace.operators import suggest
from terrace.sources import providers, registry


def ask(spark, *places):
    return spark.createDataFrame([(*p, "package") for p in places], "suburb string, state string, kind string")


def test_a_call_is_tried_again_and_failures_are_rows(spark, tmp_path):
    log = str(tmp_path)

    def call(suburb, state, kind):
        tried = len(list(Path(log).glob(f"{suburb}-*")))
        Path(log, f"{suburb}-{tried}").touch()
        if suburb == "busy" and tried < 2:
            raise providers.Unanswered("429", again=True, wait=0.0)
        if suburb == "wrong":
            raise providers.Unanswered("404")
        if suburb == "broken":
            raise OSError("no route")
        return [{"comp_id": "1", "price": 5.0, "bedrooms": 3}, {"comp_id": "2", "price_from": 4.0, "price_to": 8.0}, {"comp_id": "3"}] if suburb != "empty" else []

    found = providers.Called(call, tries=3, wait=0.0).search(ask(spark, ("busy", "NSW"), ("wrong", "VIC"), ("broken", "VIC"), ("empty", "SA"))).cache()
    rows, counts = providers.comparables(found)
    assert {(r.suburb, r.comp_id): (r.price, r.basis, r.is_estimate) for r in rows.collect()} == {("busy", "1"): (5.0, "exact", False), ("busy", "2"): (6.0, "range-mid", True)}
    assert {r.suburb: (r.found, r.withheld, r.failed) for r in counts.collect()} == {"busy": (3, 1, 0), "wrong": (0, 0, 1), "broken": (0, 0, 1)}
    assert {r.suburb: r.error for r in found.where("error IS NOT NULL").collect()} == {"wrong": "404", "broken": "OSError: no route"}
    assert {s: len(list(tmp_path.glob(f"{s}-*"))) for s in ("busy", "wrong", "broken", "empty")} == {"busy": 3, "wrong": 1, "broken": 3, "empty": 1}


def test_nobody_says_why(spark):
    nobody = providers.provider("other", {"one": lambda: None})
    assert "other" in nobody.reason and nobody.search(ask(spark, ("a", "b"))).count() == 0
    assert "not configured" in providers.provider("one", {"one": lambda: None}).reason
    assert providers.provider(None, {}).name == "none"


COMPANY = "builder_name string, states array<string>, contract_available string, agent_available string, portal_url string, notes string"
COMPANIES = [("Acme, \"the\" one", ["NSW", "VIC"], "Yes", None, "https://a", "mail a@b.com\nor 0412 345 678, 02 9999 8888"), (" ", None, None, None, None, "nobody"), ("Twin", None, "", "No", None, None), ("Twin", None, "", "No", None, None), ("Müller", [], None, None, None, "ring +61 4 1234 5678")]


def test_the_registry_is_read_back(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert registry.write_registry(spark.createDataFrame(COMPANIES, COMPANY), path) == 4
    kept = {r.c3: tuple(r) for r in registry.read_registry(spark, path).collect()}
    assert kept["Acme, \"the\" one"] == ("", "", "", "Acme, \"the\" one", "NSW/VIC", "Yes", "", "https://a", "", "", "mail [contact detail removed] or [contact detail removed], [contact detail removed]")
    assert kept["Müller"][10] == "ring [contact detail removed]" and len(kept) == 3
    assert registry.write_registry(spark.createDataFrame(COMPANIES[2:3], COMPANY), path) == 1  # replaces what was there
    assert [p.name for p in tmp_path.iterdir()] == ["registry"]


def test_a_cut_or_changed_file_is_refused(spark, tmp_path):
    path = tmp_path / "registry"
    rows = registry.public_rows(spark.createDataFrame(COMPANIES, COMPANY))
    written = rows.agg(*registry.fingerprint()).first().asDict()
    registry.write_registry(spark.createDataFrame(COMPANIES, COMPANY), str(path))
    assert registry.check_registry(spark, str(path), written) == 4
    part = max(path.glob("*.csv"), key=lambda p: p.stat().st_size)
    (path / f".{part.name}.crc").unlink(missing_ok=True)
    whole = part.read_text()
    part.write_text(whole[: whole.rindex("\n", 0, -1) + 1])
    with pytest.raises(ValueError, match="read back"):
        registry.check_registry(spark, str(path), written)
    part.write_text(whole.replace("NSW/VIC", "NSW/QLD").replace("Müller", "Muller"))
    with pytest.raises(ValueError):
        registry.check_registry(spark, str(path), written)


def test_a_file_with_a_password_is_refused_and_nothing_is_left(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "registry"), registry.public_rows
    monkeypatch.setattr(registry, "public_rows", lambda df: real(df).withColumn("c9", F.lit("secret")))
    with pytest.raises(ValueError, match="PASSWORD"):
        registry.write_registry(spark.createDataFrame(COMPANIES, COMPANY), path)
    assert list(tmp_path.iterdir()) == []


def test_completions_equal_a_plain_version(spark):
    places = [(f"{a}{b} {c}", s, n % 7) for n, (a, b, c, s) in enumerate((a, b, c, s) for a in "Tt" for b in ("oo", "ow", "é") for c in ("bay", "hill", "") for s in ("QLD", "NSW"))] + [("", "SA", 9), (None, "SA", 9), ("Toowoomba Long Name", "QLD", 50)]
    got = {(r.prefix, r.place): (r.suburb, r.state, r.listings) for r in suggest.completions(spark.createDataFrame(places, "suburb string, state string, listings long"), 4, 3).collect()}
    want = {}
    for k in range(1, 4):
        for prefix in {p[0].strip().lower()[:k] for p in places if p[0] and len(p[0].strip()) >= k}:
            fits = sorted((p for p in places if p[0] and p[0].strip().lower().startswith(prefix)), key=lambda p: (-p[2], p[0].lower(), p[0], p[1]))
            want |= {(prefix, i + 1): tuple(p) for i, p in enumerate(fits[:4])}
    assert got == want


def test_places_know_what_they_hold(spark):
    listings = spark.createDataFrame([("toowoomba ", "qld", ""), ("TOOWOOMBA", "QLD", ""), ("Toowoomba", "QLD", "x"), ("Toowoomba", "NSW", ""), (None, None, "")], "suburb string, state string, superseded_by string")
    held = suggest.held(spark.createDataFrame([("Toowoomba", "QLD"), ("Toobeah", "QLD")], "suburb string, state string"), listings, F.col("superseded_by") == "")
    assert {tuple(r) for r in held.collect()} == {("Toowoomba", "QLD", 2), ("Toobeah", "QLD", 0)}
