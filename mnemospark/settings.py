"""Settings of an engine, read from the environment where they are not given."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Where the agents keep their sessions, below the user's home.
SESSION_FOLDERS = {"claude": ".claude/projects", "codex": ".codex/sessions", "gemini": ".gemini/tmp"}


def _env(name: str, default: str = "") -> str:
    return os.environ.get(f"MNEMOSPARK_{name}", default)


def _folders() -> dict[str, str]:
    home = os.path.expanduser("~")
    return {agent: _env(f"{agent.upper()}_SESSIONS", os.path.join(home, folder)) for agent, folder in SESSION_FOLDERS.items()}


@dataclass(frozen=True)
class Settings:
    """``MNEMOSPARK_HOME``, ``_CLAUDE_SESSIONS``, ``_CODEX_SESSIONS``, ``_GEMINI_SESSIONS``, ``_REDACT_ENTROPY`` (1, true or
    yes), ``_WORK_PENALTY`` (places), ``_COMMIT_WINDOW_MIN`` and ``_EMBED_BACKEND`` (``hashing`` or ``none``)."""

    home: str = field(default_factory=lambda: _env("HOME", os.path.expanduser("~/.mnemospark")))
    sessions: dict[str, str] = field(default_factory=_folders)
    redact_entropy: bool = field(default_factory=lambda: _env("REDACT_ENTROPY").lower() in ("1", "true", "yes"))
    work_penalty: int = field(default_factory=lambda: int(_env("WORK_PENALTY", "8")))
    commit_window_min: int = field(default_factory=lambda: int(_env("COMMIT_WINDOW_MIN", "180")))
    embed_backend: str = field(default_factory=lambda: _env("EMBED_BACKEND", "hashing").lower())
