"""canvass.plans"""
