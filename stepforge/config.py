"""Constants of the scoring, subset and evaluation operators."""

from __future__ import annotations

from dataclasses import dataclass

# Words, patterns, extensions, weights and limits that define the metrics.
ERROR_KEYWORDS = (
    "traceback", "error", "exception", "failed", "failure", "syntaxerror", "typeerror", "valueerror", "assertionerror",
    "nameerror", "attributeerror", "importerror", "keyerror", "runtimeerror", "oserror", "errno", "stderr",
    "command not found", "no such file", "permission denied",
)
NOISE_PATTERNS = (
    "traceback", "error:", "warning:", "exception:", " failed", "errno", "stderr", "at line ", "raise ", "syntaxerror",
    "typeerror", "valueerror", "assertionerror", "nameerror", "attributeerror", "importerror",
)
FILE_EXTENSIONS = (
    "py", "txt", "json", "yaml", "yml", "cfg", "ini", "md", "sh", "js", "ts", "cpp", "h", "c", "java", "rb", "go", "rs",
    "toml", "xml", "html", "css", "sql",
)
TEST_KEYWORDS = ("pytest", "unittest", "tox", "nose", "coverage", "run_tests", "test_")
SUCCESS_STATUS = ("submit", "success", "resolved")
FAILURE_STATUS = ("error", "timeout", "failed", "exit_cost")
V1_WEIGHTS = {"truncation_ratio": 0.30, "outcome_success": 0.25, "step_efficiency": 0.20, "observation_noise": 0.15, "action_diversity": 0.10}
V2_GROUPS = {"correctness": 0.35, "efficiency": 0.30, "style": 0.25, "completeness": 0.10}
ACTION_PATTERNS = (
    ("bash", r'"name"\s*:\s*"(execute_bash|bash|run_command)"'),
    ("edit", r'"name"\s*:\s*"(str_replace_editor|write_file|edit_file|create_file|str_replace)"'),
    ("search", r'"name"\s*:\s*"(search|grep|find|read_file|view|open_file)"'),
    ("think", r"<think>|<reasoning>"),
    ("finish", r'"name"\s*:\s*"(finish|submit|exit)"'),
    ("tool_call_other", r"<tool_call>"),
)
PATH_PATTERN = r'(?m)(?:"(?:path|file_path|filename|target_file)"\s*:\s*"([^"]+)"|(?:^|[\s"])(/[\w./\-]+\.\w+)|(?:^|[\s"])([\w./\-]+/[\w./\-]+\.\w+))'


@dataclass(frozen=True)
class Limits:
    """Windows, thresholds and sizes; pass another instance to change them."""

    context_window: int = 131_072
    gate_ratio: float = 0.9
    redundancy_window: int = 5
    most_cycles: int = 10
    step_ratio_low: float = 0.5
    step_ratio_high: float = 3.0
    observation_chars: int = 10_000
    test_set_size: int = 200
    test_set_quantile: float = 0.9
    seed: int = 42
    sequence_tokens: int = 32_768
    label_mask: int = -100
    bootstrap_rounds: int = 2000


LIMITS = Limits()
