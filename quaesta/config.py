"""Constants and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Defaults that results depend on.
EMBEDDING_DIMENSIONS = 768
TOP_K = 5
MIN_RETRIEVAL_SCORE = 0.55
CHUNK_MAX_CHARACTERS = 1600
CHUNK_OVERLAP_CHARACTERS = 200
KNOWLEDGE_BASE_VERSION = "insurance_documents"
LLM_TEMPERATURE, LLM_MAX_TOKENS = 0, 4096
LANGUAGES = ("en", "fr")
DOCUMENT_TYPES = ("policy_wording", "underwriting_guide", "underwriting_appetite", "exclusions_reference", "pricing_guide", "procedure")
STATUSES = ("active", "archived", "draft")
CONFIDENCES = ("high", "medium", "low")
FILTER_FIELDS = ("coverage", "jurisdiction", "language", "document_type", "version")


@dataclass(frozen=True)
class Settings:
    """Model settings from the environment, then an optional ``.env`` file; unknown keys are ignored."""

    llm_api_key: str | None = None
    llm_model_name: str = "openai/gpt-oss-20b"
    extra: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def load(cls, env_file: str = ".env") -> Settings:
        values = {}
        if os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as f:
                for line in f:
                    name, eq, value = line.strip().partition("=")
                    if eq and not name.startswith("#"):
                        values[name.strip().upper()] = value.strip().strip("'\"")
        values |= {k.upper(): v for k, v in os.environ.items()}
        return cls(values.get("GROQ_API_KEY"), values.get("GROQ_MODEL_NAME", cls.llm_model_name))
