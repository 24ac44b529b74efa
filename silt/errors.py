"""Coded errors and the process exit code of each."""

from __future__ import annotations

from typing import Any

# Code -> (exit code, what to do about it).
CODES: dict[str, tuple[int, str]] = {
    "empty_log": (65, "the log has no commits; pass a log of at least one"),
    "input_file_open_failed": (74, "a definition file can't be opened; check its path"),
    "invalid_after_date": (64, "dates are written YYYY-MM-DD"),
    "invalid_control_char": (65, "the log holds control characters; it should be plain text"),
    "invalid_expression": (64, "pass a regular expression of at most 1000 bytes, without lookaround or backreferences"),
    "invalid_field": (64, "see the command's schema for the paths it has"),
    "invalid_glob": (64, "globs match the whole path; ** spans directories"),
    "invalid_group": (64, "a rule is written: pattern => name"),
    "invalid_team_map": (65, "a row is written: author,team; JSON is an object or a list of {author, team}"),
    "invalid_temporal_date": (65, "windows need real dates; make the log with the printed command"),
    "invalid_temporal_period": (64, "a period is a positive number of days"),
    "invalid_time_now": (64, "pass a date as YYYY-MM-DD, or none for today"),
    "invalid_value": (64, "see --help for the values a flag takes"),
    "log_open_failed": (74, "the log can't be opened; check its path"),
    "missing_messages": (65, "the log has no commit subjects; make it with the printed command"),
    "missing_metrics": (65, "the log has no line counts; make it with --numstat"),
    "missing_required_flag": (64, "see --help for the flags a command needs"),
    "parse_error": (65, "an entry isn't in the expected format; make the log with the printed command"),
    "unknown_command": (64, "see --help for the commands"),
    "unknown_flag": (64, "see --help for a command's flags"),
    "unknown_schema_command": (64, "call schema alone for all commands"),
}
# Codes that every analysis may end with.
COMMON = [
    "input_file_open_failed", "internal_error", "invalid_control_char", "invalid_field", "invalid_glob", "invalid_group", "invalid_team_map", "invalid_temporal_date",
    "invalid_temporal_period", "invalid_value", "log_open_failed", "missing_required_flag", "parse_error", "unknown_flag",
]
EXIT_CODES = [0, 64, 65, 70, 74]


class SiltError(Exception):
    """An error with a stable code; ``details`` is data for whoever handles it."""

    def __init__(self, code: str, message: str, details: dict[str, Any] | None = None):
        super().__init__(message)
        self.code, self.details = code, details

    @property
    def exit_code(self) -> int:
        return CODES.get(self.code, (70, ""))[0]

    def envelope(self) -> dict[str, Any]:
        error: dict[str, Any] = {"code": self.code, "message": str(self)}
        if hint := CODES.get(self.code, (70, ""))[1]:
            error["hint"] = hint
        if self.details:
            error["details"] = self.details
        return {"schema_version": 1, "ok": False, "error": error}
