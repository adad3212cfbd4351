"""The same decision function over batch and streaming frames."""
