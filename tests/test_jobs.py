"""The four steps from a CSV export to reports."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import types as T

from paperloom.operators.scoring import MATERIAL, METHOD, RELEVANCE, per_paper
from paperloom.operators import counting
from paperloom.plans import jobs
from paperloom.sources.scores import score_attempts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXPORT = (
    "Article Title,Author Keywords,Keywords Plus,Abstract,Publication Year,Source Title\n"
    'Mining graphene papers,nlp,,"line one\nline two",2020,J1\n'
    "A steel beam,,,bending,2021,J2\n"
    '"Polymers, mined",ner,x,text,2021,J1\n'
    "No title match,,,mining,n/a,\n"
)


def relevance(prompt):
    paper = prompt.split("\n\n")[0]
    return ("1" if "min" in paper.lower() else "0"), 3


def method(prompt):
    record = {"primary_category": "Large Language Models (LLMs)", "specific_models": ["GPT-4"], "secondary_tags": [], "confidence": "high"}
    return json.dumps(record), 3


def material(prompt):
    label = "2D Materials" if "Mining graphene" in prompt else "Polymers"
    return json.dumps({"material_categories": [label, "Other Materials"], "confidence": "low", "primary_category": label}), 3


def test_steps_over_csv(spark, tmp_path):
    source = tmp_path / "combined.csv"
    source.write_text(EXPORT, encoding="utf-8-sig")

    def step(task, ask, read, written):
        return jobs.run_task(
            spark, str(read), str(tmp_path / written), str(tmp_path / f"scores-{task.name}"), task,
            per_paper(ask, task.guide, threads=2), fmt="csv", partitions=3,
        )

    flagged = step(RELEVANCE, relevance, source, "classified")
    assert sorted(r.is_relevant for r in flagged.collect()) == [0, 1, 1, 1]
    with_methods = step(METHOD, method, tmp_path / "classified", "with_models")
    assert with_methods.where("model_primary_category is null").select("article_title").collect()[0][0] == "A steel beam"
    done = step(MATERIAL, material, tmp_path / "with_models", "with_materials")
    assert done.count() == 4
    row = done.where("journal = 'J1' and year = 2020").first()
    assert row.abstract == "line one\nline two"
    assert row.model_specific_models == ["GPT-4"] and row.material_categories == ["2D Materials", "Other Materials"]
    assert [tuple(r) for r in counting.coverage(done, "primary_material_category").collect()] == [(4, 3, 75.0)]
    jobs.write_reports(done, str(tmp_path / "reports"))
    assert {p.name for p in (tmp_path / "reports").iterdir()} == {"material_statistics", "method_statistics", "summary_statistics"}
    again = step(MATERIAL, material, tmp_path / "with_models", "again")
    assert again.count() == 4
    assert score_attempts(spark, str(tmp_path / "scores-material"), T.StringType()).count() == 3
