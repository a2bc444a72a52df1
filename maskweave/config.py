"""Profiles and model names."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from maskweave.patterns import PATTERNS

MAX_TABLE_BYTES = 50 * 1024 * 1024
MAX_TABLE_CELLS = 500_000

# Types and operators of the safe-harbor bundle.
SAFE_HARBOR_TYPES = [
    "PERSON", "ADDRESS", "LOCATION", "DATE", "DATE_ISO", "AGE", "PHONE", "FAX", "EMAIL", "SSN", "MEDICAL_RECORD",
    "MEDICAL_NPI_US", "MEDICAL_LICENSE", "HEALTH_PLAN_ID", "ACCOUNT", "ID", "DRIVERS_LICENSE", "PASSPORT", "VIN", "MAC_ADDRESS", "URL", "IPV4_ADDRESS",
    "IPV6_ADDRESS", "IP_ADDRESS", "DEVICE_ID", "BIOMETRIC", "PHOTO", "ORGANIZATION", "INDIRECT", "CREDIT_CARD", "IBAN",
]
SAFE_HARBOR_OPERATORS = {"DATE": "generalize", "DATE_ISO": "generalize", "ADDRESS": "generalize", "AGE": "generalize"}
ENTITY_PROFILES = {"hipaa-safe-harbor": (SAFE_HARBOR_TYPES, SAFE_HARBOR_OPERATORS)}

# Providers, known models with their provider.
PROVIDERS = ("google", "ollama", "huggingface", "openrouter", "openai", "anthropic")
MODELS = {
    "gemini-2.5-pro": "google", "gemini-2.5-flash": "google", "gemini-2.5-flash-lite": "google", "gemma:7b": "ollama", "phi4-mini": "ollama",
    "mistralai/Mistral-7B-Instruct-v0.1": "huggingface", "HuggingFaceH4/zephyr-7b-beta": "huggingface", "openai/gpt-oss-20b": "huggingface",
    "openai/gpt-4o": "openrouter", "google/gemini-pro": "openrouter", "gpt-4o": "openai", "gpt-5": "openai", "claude-4-sonet": "anthropic", "claude-4.5-sonet": "anthropic",
}


@dataclass(frozen=True)
class Config:
    """How a run detects: by chunks of what size, with which model, patterns and retries."""

    model: str = "gemini-2.5-flash"
    prompt: str = "simple"
    chunk_size: int = 30_000
    chunk_overlap: int = 1_000
    max_retries: int = 3
    base_delay: float = 1.0
    max_delay: float = 10.0
    use_model: bool = True
    use_cache: bool = True
    patterns: dict[str, str] = field(default_factory=lambda: dict(PATTERNS))


# The profiles.
PROFILES = {
    "best-quality": Config("gemini-2.5-pro", "detailed", 15_000, 2_000, 5, 2.0, 60.0),
    "best-speed": Config("gemini-2.5-flash", "simple", 30_000, 1_000, 3, 1.0, 10.0),
    "best-cost": Config("gemini-2.5-flash-lite", "simple", 60_000, 3_000, 3, 1.0, 15.0),
    "regex-only": Config("none", "simple", 200_000, 0, 1, 1.0, 1.0, use_model=False, use_cache=False),
}


def profile(name: str = "best-speed", **overrides: object) -> Config:
    """A profile with single values replaced; None keeps the profile's value."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(PROFILES)}")
    return replace(PROFILES[name], **{k: v for k, v in overrides.items() if v is not None})


def entity_profile(name: str | None, operators: dict[str, str] | None = None) -> tuple[list[str] | None, dict[str, str]]:
    """(types, operators) of a bundle; the caller's operators win."""
    types, own = ENTITY_PROFILES[name] if name else (None, {})
    return (list(types) if types else None), own | (operators or {})


def resolve_model(name: str) -> tuple[str, str]:
    """(provider, model): known names first, then ``provider/model``."""
    if name in MODELS:
        return MODELS[name], name
    provider, slash, model = name.partition("/")
    if not slash:
        raise ValueError(f"{name!r} is neither a known model nor provider/model")
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}")
    return provider, model
