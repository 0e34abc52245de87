"""Status names and verdict texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Run status codes.
RUN_STATUS = {
    0: "Normal",
    1: "Invalid",
    2: "Runtime Error",
    3: "Memory Limit Exceeded",
    4: "Time Limit Exceeded",
    5: "Output Limit Exceeded",
    6: "Disallowed Syscall",
    7: "Fatal Error",
}
UNKNOWN_STATUS = "Unknown"

# Submission verdicts.
ACCEPTED = "Accepted"
WRONG_ANSWER = "Wrong Answer"
TIME_LIMIT = "Time Limit Exceeded"
MEMORY_LIMIT = "Memory Limit Exceeded"
RUNTIME_ERROR = "Runtime Error"
COMPILE_ERROR = "Compilation Error"
SYSTEM_ERROR = "System Error"

NOT_ACCEPTED = [WRONG_ANSWER, TIME_LIMIT, MEMORY_LIMIT, RUNTIME_ERROR, COMPILE_ERROR, SYSTEM_ERROR]

SYSTEM_FAULTS = ["Fatal Error", "Disallowed Syscall", "Invalid", "Unknown"]
WRONG_OUTPUT = ["Normal", "Output Limit Exceeded"]


def run_status_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(part) for pair in RUN_STATUS.items() for part in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit(UNKNOWN_STATUS))
