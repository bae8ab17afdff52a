"""Errors as ``CODE message``, with their classes and retry delays."""

from __future__ import annotations

# The codes that clients match on, their classes, and retry delays in ms.
CODES = (
    "CLUSTERDOWN", "TRYAGAIN", "TIMEOUT", "SYNTAX", "INVALIDARG", "NOTFOUND", "MAXFORWARDS", "CIRCUITOPEN", "CONFIRMFAILED", "REPLCONFIRMFAILED", "CLOCKERR", "READERR",
    "WRITEERR", "REMOTEERR", "NOISEERR", "TRANSPORTERR", "SWARMERR", "ACTORDOWN", "ACTORSTOPPED", "MAILBOXFULL", "ALLREPLICASFAILED", "BUFFEREVICTED", "BUFFERFULL",
    "DBOPFAILED", "INSUFFICIENTREPLICAS", "INVALIDSENDER", "STALEWRITE", "MISSINGPARTSEQ", "PARTNOTOWNED", "QUORUMFAILED", "REMOTEOPFAILED", "SEQCONFLICT", "WRONGSEQ", "WRONGVER", "REDIRECT",
)
RETRY_MS = {"TRYAGAIN": 100, "TIMEOUT": 1000, "CIRCUITOPEN": 5000, "ACTORDOWN": 500, "ACTORSTOPPED": 500, "MAILBOXFULL": 200}
CLUSTER = ("CLUSTERDOWN", "READERR", "WRITEERR", "REMOTEERR", "NOISEERR", "TRANSPORTERR", "SWARMERR")
CLIENT = ("SYNTAX", "INVALIDARG")


class EngineError(Exception):
    """An error of a command; its text is the code and the message."""

    def __init__(self, code: str, message: str = ""):
        self.code, self.message = code, message
        super().__init__(f"{code} {message}".rstrip())

    @property
    def retryable(self) -> bool:
        return self.code in RETRY_MS

    @property
    def retry_delay_ms(self) -> int | None:
        return RETRY_MS.get(self.code)

    @property
    def is_cluster_issue(self) -> bool:
        return self.code in CLUSTER

    @property
    def is_client_error(self) -> bool:
        return self.code in CLIENT

    @classmethod
    def parse(cls, text: str) -> EngineError:
        """From its text; an unknown code stays part of the message of a READERR."""
        code, _, message = text.partition(" ")
        return cls(code, message) if code in CODES else cls("READERR", text)


def invalid(message: str) -> EngineError:
    return EngineError("INVALIDARG", message)
