"""Client for a local chat-model endpoint, used inside executor tasks."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from ..functions.lexicon import RELATION_TYPES
from ..operators.joint import RelationModel

# Extractor configuration: our own wording of the task.
SYSTEM = (
    "You find spatial relations between places in a passage. A relation links a located place "
    "(location_1) to a reference place (location_2) through the words that express it "
    "(spatial_indicator). Copy all three word for word. List the matching kinds in semantic_type: "
    "REGION, DIRECTION, DISTANCE. Answer with one JSON object holding a list under "
    "location_relations, empty when there is none."
)
USER = "Passage:\n{sentence}"
STRICTER = " Answer with the JSON object only."

JOINT_SYSTEM = (
    "You list the spatial relations that a passage of fiction states between named places. Each relation has entity_1 and "
    "entity_2 (names as written; entity_2 may be null for on_coast), relation_type (one of " + ", ".join(RELATION_TYPES) + "), "
    "entity_1_type and entity_2_type (GPE, LOC or FAC), entity_1_class and entity_2_class (real, fictional or uncertain), "
    "confidence from 0 to 1, and distance_value with distance_unit (miles or km) where the passage gives a distance, else null. "
    "Answer with one JSON object holding a list under relations, empty when there is none."
)
JOINT_STRICTER = " The last answer could not be used: reply with that JSON object and nothing before or after it."


def relation_model(make_client: Callable[[], Callable[[str, str, float], str]], **settings) -> RelationModel:
    """Joint extractor with these prompts over any chat client."""
    return RelationModel(make_client, JOINT_SYSTEM, USER, JOINT_STRICTER, **settings)


def _post(url: str, payload: dict, timeout: int) -> dict:
    request = urllib.request.Request(
        url, data=json.dumps(payload).encode(), headers={"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def client(host: str = "http://localhost:11434", model: str = "mistral",
           timeout: int = 90, answer_tokens: int = 1024) -> Callable[[], Callable[[str, str, float], str]]:
    """Factory for ``ModelExtractor.make_client``: JSON mode, bounded answer length."""
    def make():
        def chat(system: str, user: str, temperature: float) -> str:
            payload = {
                "model": model, "stream": False, "format": "json",
                "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}],
                "options": {"temperature": temperature, "top_p": 0.9, "num_predict": answer_tokens},
            }
            return _post(host.rstrip("/") + "/api/chat", payload, timeout)["message"]["content"]
        return chat
    return make
