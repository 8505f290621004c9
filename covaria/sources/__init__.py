"""covaria.sources"""
