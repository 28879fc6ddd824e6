"""Operations of a training-data pipeline: duplicates, personal data, language, quality, toxicity, tokens."""
