"""Tables of the log: deriving, storing and loading them."""
