"""Change queues and state machines, as streams and as their batch twins."""
