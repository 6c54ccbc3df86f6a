"""listingops: second-hand resale operations as Spark jobs over many sellers' lots at once."""
