"""Models for tests, made on executors by their path."""


class NotingJudge:
    """Scores every reply 4 and notes each call as a line of a file."""

    def __init__(self, path):
        self.path = path

    def __call__(self, prompt):
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(repr(prompt) + "\n")
        return 'Here: {"score": 4, "explanation": "fine"}'


class Lengths:
    """An encoder: vectors from counts of letters."""

    def __call__(self, texts):
        return [[1.0 + t.count("a"), len(t), 1.0] for t in texts]


def speaker(word="Now turn the wheel"):
    """A generator that speaks in every third request."""
    from cadenza.models import Reply

    return lambda system, messages: Reply(word if sum(len(m["parts"]) for m in messages) % 3 == 0 else "Silent", 7, 2, 9, 1)
