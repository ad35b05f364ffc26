"""engram: a PySpark-native analytics engine over long-term conversational and document memory."""
