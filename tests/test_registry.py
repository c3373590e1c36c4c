"""The registry's tables and checks on small inputs."""

import json

from tidemark.sources.entities import load_registry, registry_aliases, registry_problems

SEEDS = [
    {"id": "a", "name": "Hugging Face", "operator_relevance": 3.0, "aliases": ["Hugging Face", "HuggingFace", "Café"], "case_sensitive_aliases": ["HF"]},
    {"id": "b", "name": "Next", "operator_relevance": 1.0, "aliases": ["Next.js", "cafe"]},
    {"id": "b", "name": "Next again", "operator_relevance": 1.0, "aliases": ["NextJS", "!!"]},
    {"id": "c", "name": None, "operator_relevance": None, "aliases": None},
]


def test_registry(spark, tmp_path):
    file = tmp_path / "seeds.json"
    file.write_text("\n".join(map(json.dumps, SEEDS)))
    entities, aliases = load_registry(spark, str(file))
    assert sorted(r["id"] for r in entities.collect()) == ["a", "b", "b", "c"]
    found = {(r["entity_id"], r["normalized"]): (r["alias"], r["requires_exact_case"]) for r in aliases.collect()}
    assert found[("a", "huggingface")] == ("Hugging Face", False)
    assert found[("a", "hf")] == ("HF", True)
    assert {k for k in found if k[0] == "b"} == {("b", "nextjs"), ("b", "cafe"), ("b", "")}
    stray = spark.createDataFrame([("zz", "Z", "z", False)], aliases.schema)
    problems = {tuple(r) for r in registry_problems(entities, aliases.unionByName(stray)).collect()}
    assert problems == {("duplicate_entity", "b", 2), ("empty_alias", "b", 1), ("unknown_entity", "zz", 1), ("shared_alias", "cafe", 2)}


def test_empty_registry(spark):
    seeds = spark.createDataFrame([], "id string, aliases array<string>, case_sensitive_aliases array<string>")
    aliases = registry_aliases(seeds)
    assert aliases.count() == 0
    assert registry_problems(seeds, aliases).count() == 0
