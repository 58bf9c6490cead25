"""The twelve tools as calls with JSON arguments, their text forms, and a JSON-RPC loop."""
