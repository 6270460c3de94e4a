"""Knowledge-base, search, evaluation, model and context operators."""
