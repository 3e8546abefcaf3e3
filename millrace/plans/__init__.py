"""Plans: operators put together to what a user asks for."""

from .introspection import TOPICS, doctor, overview, topics_frame, whoami

__all__ = ["TOPICS", "doctor", "overview", "topics_frame", "whoami"]
