"""Small run records for tests."""

import json

from runscore.schemas import RUN_DDL

RUN_INPUT = RUN_DDL + ", expected_outputs array<string>, dataset_summary string"


def record(**fields):
    base = {"run_id": "r", "mode": "baseline", "query": "q", "dataset_path": "d.csv"}
    return {**base, **fields}


def frame(spark, *records):
    """Records as a DataFrame of the run schema; sparse fields are null."""
    lines = [(json.dumps(r),) for r in records]
    text = spark.createDataFrame(lines, "value string")
    return text.selectExpr(f"from_json(value, '{RUN_INPUT}') AS r").select("r.*")


def execution(status="success", stdout="", stderr="", files=(), error=None):
    return {
        "status": status, "stdout": stdout, "stderr": stderr, "output_files": list(files),
        "error_message": error,
    }


def run(code, task, stdout="", stderr="", status="success", files=(), expected=(), summary="",
        mode="baseline", error=None):
    return record(
        query=task, generated_code=code, mode=mode, expected_outputs=list(expected),
        dataset_summary=summary, execution=execution(status, stdout, stderr, files, error),
    )


COMPONENT_ORDER = [
    "data_understanding", "preprocessing", "feature_engineering", "model_selection",
    "evaluation_strategy", "statistical_validity", "business_alignment", "explainability",
]


def evaluation(score, components=None, **more):
    out = {"task_completion_score": score, "execution_success": True, "output_completeness": 1.0}
    if components is not None:
        out["decision_evaluation"] = {
            "decision_score": 70.0, "confidence": 0.8, "summary": "ok",
            "scores": dict(zip(COMPONENT_ORDER, components)),
        }
    return {**out, **more}


def rounds(*scores):
    return [
        {"iteration": i, "score": s, "passed": s >= 0.75, "items": [], "summary": ""}
        for i, s in enumerate(scores)
    ]
