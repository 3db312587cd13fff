"""Record schemas, vocabularies and thresholds shared by every operator."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
METRICS = ["TCR", "ESR", "RR", "FIS", "DA", "DQS", "BAS", "ORS"]

COMPONENTS = {
    "data_understanding": "Data Understanding",
    "preprocessing": "Preprocessing",
    "feature_engineering": "Feature Engineering",
    "model_selection": "Model Selection",
    "evaluation_strategy": "Evaluation Strategy",
    "statistical_validity": "Statistical Validity",
    "business_alignment": "Business Alignment",
    "explainability": "Explainability",
}

DQS_WEIGHTS = {
    "data_understanding": 0.10,
    "preprocessing": 0.15,
    "feature_engineering": 0.15,
    "model_selection": 0.20,
    "evaluation_strategy": 0.15,
    "statistical_validity": 0.10,
    "explainability": 0.05,
    "business_alignment": 0.10,
}

DA_COMPONENTS = [
    "data_understanding",
    "preprocessing",
    "model_selection",
    "evaluation_strategy",
    "statistical_validity",
    "business_alignment",
]

ORS_WEIGHTS = {"tcr": 0.15, "esr": 0.15, "da": 0.20, "dqs": 0.20, "bas": 0.15, "fis": 0.15}

DIFFICULTY_RANK = {"easy": 1, "medium": 2, "hard": 3, "very_hard": 4, "expert": 5}

SEVERITY_WEIGHT = {"high": 0.4, "medium": 0.15}
OTHER_SEVERITY_WEIGHT = 0.05

STATUSES = ["success", "failure", "timeout", "blocked"]
BASELINE, FEEDBACK = "baseline", "feedback_loop"

PASS_THRESHOLD = 0.75
QUALIFY_THRESHOLD = 0.8
COMPLETED_THRESHOLD = 0.7
CORRECT_THRESHOLD = 0.5
DECISION_GATE = 70.0
COMPONENT_GATE = 7.0
MAX_ROUNDS = 3
# ----------------------------------------------------------------------------

GAP_DDL = "struct<category:string,severity:string,message:string,recommendation:string>"
GAPS_DDL = f"array<{GAP_DDL}>"

_SCORES_DDL = "struct<" + ",".join(f"{name}:double" for name in COMPONENTS) + ">"

CRITIC_DDL = (
    f"struct<decision_score:double,scores:{_SCORES_DDL},strengths:array<string>,"
    "weaknesses:array<string>,recommendations:array<string>,confidence:double,summary:string>"
)

FEEDBACK_DDL = (
    f"struct<iteration:int,score:double,passed:boolean,items:{GAPS_DDL},summary:string,"
    "qualification_score:double,qualified:boolean,decision_score:double,"
    "decision_summary:string,decision_recommendations:array<string>>"
)

EXECUTION_DDL = (
    "struct<status:string,stdout:string,stderr:string,return_code:int,"
    "duration_seconds:double,output_files:array<string>,error_message:string>"
)

EVALUATION_DDL = (
    "struct<task_completion_score:double,execution_success:boolean,output_completeness:double,"
    "visualization_present:boolean,ml_metrics_valid:boolean,notes:string,"
    "qualification_score:double,task_qualified:boolean,"
    f"decision_evaluation:{CRITIC_DDL},decision_quality_score:double,"
    f"structured_feedback:{FEEDBACK_DDL}>"
)

RUN_DDL = (
    "run_id string, mode string, query string, dataset_path string, plan string, "
    f"generated_code string, execution {EXECUTION_DDL}, evaluation {EVALUATION_DDL}, "
    f"feedback_history array<{FEEDBACK_DDL}>, final_report string, iterations int, "
    "recovered_from_failure boolean, metrics map<string,double>, "
    "metadata map<string,string>, created_at timestamp"
)

TASK_DDL = (
    "id string, category string, difficulty string, dataset string, target_column string, "
    "query string, expected_outputs array<string>"
)

LOG_DDL = (
    "timestamp timestamp, level string, logger string, message string, "
    "data map<string,string>, exception string"
)

RUN_FIELDS = [
    "run_id", "mode", "query", "dataset_path", "plan", "generated_code", "execution",
    "evaluation", "feedback_history", "final_report", "iterations", "recovered_from_failure",
    "metrics", "metadata", "created_at",
]
