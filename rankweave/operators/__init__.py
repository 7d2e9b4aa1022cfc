"""DataFrame operators over dates and symbols."""
