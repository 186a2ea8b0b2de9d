"""Extensions for streams; the engine itself works on tables."""
